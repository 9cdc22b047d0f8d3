"""Text clean-up, redaction, estimates, chunking."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuscope.functions import chunking as C
from corpuscope.functions import text as X


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "text string").select(expr.alias("v")).first()["v"]


def test_trim_strips_control_characters(spark):
    assert one(spark, "\n a \t", X.jtrim("text")) == "a"


def test_page_text_loses_footers_and_cjk_spacing(spark):
    text = "标 题 ，内容\r\nNo. 3/12\r\n\r\n\r\n\r\nSpark 教 程  end"
    assert one(spark, text, X.clean_page_text("text")) == "标题，内容\n\nSpark教程end"


def test_audit_message_hides_secrets(spark):
    raw = "call to https://host/path?x=1 with Bearer abc.def-1 and api_key=verysecret and sk-abcdefgh1234 broke"
    out = one(spark, raw, X.audit_message("text"))
    assert "https" not in out and "abc.def" not in out and "verysecret" not in out and "sk-abc" not in out
    assert one(spark, "HTTP 429 from provider", X.audit_message("text")) == "RATE_LIMIT"
    assert len(one(spark, "x" * 500, X.audit_message("text"))) == 203


def test_token_estimate(spark):
    assert one(spark, "abcd 中文é", X.token_estimate("text")) == math.ceil(4 * 0.3 + 2 * 0.95 + 0.55 + 12)
    assert one(spark, " \n", X.token_estimate("text")) == 0


def test_tokens_add_han_bigrams(spark):
    assert one(spark, "BM25 检索系统 a", X.tokens("text")) == ["bm25", "检索系统", "检索", "索系", "系统"]


def test_evidence_snippet_order(spark):
    def snippet(anchor, matched):
        df = spark.createDataFrame([(anchor, matched)], "a string, m string")
        return df.select(X.evidence_snippet("a", "m", F.lit("why")).alias("v")).first()["v"]

    assert snippet("Head", "body") == "Head"
    assert snippet("", "Short! This sentence is long enough; rest") == "This sentence is long enough;"
    assert snippet(None, " ") == "why"


# --- chunking against a plain re-statement of the rules --------------------------------------------

def trim(s):
    return s.strip("".join(map(chr, range(33))))


def plain_tokens(s):
    return re.findall(r"[A-Za-z0-9_]+|\s+|.", s, re.DOTALL)


def plain_pack(pieces, size, flush_trim, long=None):
    out, cur = [], ""
    for piece in pieces:
        if long and len(piece) > size and len(cur) + len(piece) > size:
            out += [trim(cur)] if cur else []
            out += long(piece)
            cur = ""
        elif cur and len(cur) + len(piece) > size:
            out.append(trim(cur) if flush_trim else cur)
            cur = piece
        else:
            cur += piece
    return out + ([trim(cur) if flush_trim else cur] if cur else [])


def plain_chunks(text, size, overlap, minimum):
    def words(sentence):
        return plain_pack(plain_tokens(sentence), size, False)

    base, cur = [], ""
    for p in [trim(p) for p in re.split(r"\n\n+", text)]:
        if not p:
            continue
        if len(p) > size:
            base += [trim(cur)] if cur else []
            base += plain_pack(re.split(r"(?<=[。！？；])|(?<=[.!?;])\s+", p), size, True, words)
            cur = ""
        elif cur and len(cur) + len(p) + 2 > size:
            base.append(trim(cur))
            cur = p
        else:
            cur = cur + "\n\n" + p if cur else p
    base += [trim(cur)] if cur else []
    over = min(overlap, size - 1) if overlap > 0 and size > 1 else 0
    merged = []
    for c in [trim(c) for c in base]:
        if not c:
            continue
        if merged and (len(c) < min(minimum, size) or len(merged[-1]) < min(minimum, size)) and len(merged[-1]) + 2 + len(c) <= size + over:
            merged[-1] += "\n\n" + c
        else:
            merged.append(c)

    def tail(s):
        s = trim(s)
        if len(s) <= over:
            return s
        out = ""
        for w in reversed(plain_tokens(s)):
            if len(out) + len(w) > over:
                break
            out = w + out
        return out or s[-over:]

    def head(s):
        out = ""
        units = [trim(u) for u in re.findall("[^。！？；.!?;]+[。！？；.!?;]?", s)]
        for u in reversed([u for u in units if u] or [trim(s)]):
            if len(u) > over and not out:
                out = tail(u)
                break
            if len(out) + len(u) > over:
                break
            out = u + out
        return trim(out) if out else tail(s)

    if not over:
        return merged
    return merged[:1] + [(head(a) + "\n\n" + b if head(a) else b) for a, b in zip(merged, merged[1:])]


def random_text(rng):
    words = ["alpha", "be", "gamma_9", "数据", "检索", "x" * 30, "end.", "stop!", "句。", "问？", "; ", "\n", "\n\n", "\n\n\n", " ", "  "]
    return "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(0, 120)))


@pytest.mark.parametrize("size,overlap,minimum", [(20, 10, 1), (40, 10, 15), (64, 0, 10), (512, 100, 100), (1, 5, 3)])
def test_chunks_equal_plain_rules(spark, size, overlap, minimum):
    rng = random.Random(size)
    texts = [random_text(rng) for _ in range(60)] + ["", "  \n", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = C.chunk_table(df, ["id"], size=size, overlap=overlap, minimum=minimum).collect()
    arrays = {r["id"]: r["c"] for r in df.select("id", C.chunk_text("text", size=size, overlap=overlap, minimum=minimum).alias("c")).collect()}
    got = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["pos"])):
        got.setdefault(r["id"], []).append(r["text"])
    for i, text in enumerate(texts):
        want = plain_chunks(text, size, overlap, minimum)
        assert got.get(i, []) == want
        assert arrays[i] == want


def test_sentence_pieces_rejoin(spark):
    sentence = "word_1 " * 40 + "中文分词" * 30
    pieces = one(spark, sentence, C.split_sentence(F.col("text"), 50))
    assert "".join(pieces) == sentence and max(map(len, pieces)) <= 50


def test_overlap_starts_with_previous_sentence(spark):
    df = spark.createDataFrame([("aaaaaaa. bbbbbbb. ccccccc. ddddddd.",)], "text string")
    out = [r["text"] for r in C.chunk_table(df.withColumn("id", F.lit(1)), ["id"], size=20, overlap=10, minimum=1).orderBy("pos").collect()]
    assert len(out) == 2 and out[1].startswith("bbbbbbb.")


def test_action_fingerprints_tell_unequal_arguments_apart(spark):
    from corpuscope.functions import rules

    args = ['{"k":1}', '{"k":"1"}', '{"a":"x","b":"y"}', '{"a":"x\\",\\"b\\":\\"y"}', '{"o":{"a":1,"b":[1,2]}}', '{"o":{"a":1,"b":[2,1]}}', "", "not json"]
    same = [('{"o": {"b": [1, 2], "a": 1}}', '{"o":{"a":1,"b":[1,2]}}'), ('{"t":"  a \\n b "}', '{"t":"a b"}'), (None, "{}")]
    rows = [(i, a) for i, a in enumerate(args)] + [(100 + 2 * i + j, a) for i, pair in enumerate(same) for j, a in enumerate(pair)]
    table = spark.createDataFrame(rows, "id int, args string")
    got = {r["id"]: r["f"] for r in table.select("id", rules.action_fingerprint(F.lit("search"), F.col("args")).alias("f")).collect()}
    assert len({got[i] for i in range(len(args))}) == len(args)
    assert all(got[100 + 2 * i] == got[101 + 2 * i] for i in range(len(same)))
