"""Alignment against a version that places every token on its bytes, one text at a time."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from corpuscope.llm import alignment
from corpuscope.llm.base import read
from corpuscope.llm.catalog import op11_alignment

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["a", "  ", "\n\n\t", "x  y", "<|endoftext|> and </s> <s> <unk>", "a▁b", "▁", "日本語 テキスト 😀😀 👨‍👩‍👧", " no break", "\x00 \x7f", "é é", "don't we'll 12345 67.8", "ab" * 300, " lead", "trail ", "a \n b", "\r\n"]


def brute(texts: list[str | None]) -> list[tuple]:
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    letters = alignment.byte_alphabet()
    documents, counts = [], Counter()
    for text in texts:
        data = (" " + (text or "")).encode()
        both = []
        if text:
            for ids, raw in ((a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(letters[c] for c in a.id_to_token(i))),
                             (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())):
                at, spans = 0, []
                for i in ids:
                    spans.append((i, at, at + len(raw(i))))
                    at += len(raw(i))
                both.append(spans if b"".join(raw(i) for i in ids) == data else None)
        if not text or None in both:
            documents.append(None)
            continue
        cuts = sorted({s[2] for s in both[0]} & {s[2] for s in both[1]})
        groups = [([], []) for _ in cuts]
        for k, side in enumerate(both):
            for i, _, end in side:
                groups[bisect_left(cuts, end)][k].append(i)
        links = [(x, y) for one, two in groups for x in one for y in two]
        documents.append((len(both[0]), len(both[1]), groups, links))
        counts.update(set(links))
    best: dict[int, int] = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for d in documents:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = d
        said = ";".join(f"{','.join(map(str, one))}|{','.join(map(str, two))}" for one, two in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("listed", [alignment.LISTED, 0])
def test_links(spark, docs, corpus, listed):
    rows = [*corpus, *((1000 + i, t) for i, t in enumerate(ODD)), (None, "null id"), (None, "null id"), (3, "another text of an id that is taken")]
    extra = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wide = extra.selectExpr("*", "7 AS pairs", "'x' AS n_a", "1.5 AS count_sum")
    got = alignment.linked(wide, listed=listed)
    assert got.dtypes == [(c, "string" if c == "groups_sha256" else "bigint") for c in sorted(COLUMNS, key=got.columns.index)]
    want = [(i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows]), strict=True)]
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=repr) == sorted(want, key=repr)


def test_query(spark):
    rows = read(spark, FOLDER, "documents").select("doc_id", "text").collect()
    want = {r["doc_id"]: b for r, b in zip(rows, brute([r["text"] for r in rows]), strict=True)}
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS[1:]) for r in op11_alignment(spark, FOLDER).collect()} == want


def test_empty_table(spark, no_docs):
    assert alignment.linked(no_docs).count() == 0


def test_long_texts_in_parts(monkeypatch):
    """Parts of a text give what the whole gives, and a memory that starts anew changes nothing."""
    both = alignment.Tokenizers(Path(alignment.BYTE_BPE).read_text(), Path(alignment.PIECES).read_bytes())
    text = "The quick brown fox; jumps 12 over\n the lazy  dog, and naïve 日本 words - again and again. " * 40
    whole = [c.to_pylist() for c in both.summarised([text, None, text[:50]], True)]
    monkeypatch.setattr(alignment, "LONG_TEXT", 100)
    assert len(both.pieces_of(text)) > 10 and " ".join(both.pieces_of(text)) == text
    assert [c.to_pylist() for c in both.summarised([text, None, text[:50]], True)] == whole
    monkeypatch.setattr(alignment, "MEMO", 3)
    for _ in range(3):
        assert [c.to_pylist() for c in both.summarised([text, None, text[:50]], True)] == whole


def test_both_libraries_give_the_same_ids():
    """The faster library against the one the file is made for, on every character between letters, digits, spaces and signs (a thirtieth of them here)."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(alignment.BYTE_BPE)
    slow.encode_special_tokens = True
    fast = alignment._byte_level(Path(alignment.BYTE_BPE).read_text())[0]
    points = [c for c in [*range(0x3000), *range(0x3000, 0x110000, 30)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b 1{chr(c)}1 {chr(c)} {chr(c)}{chr(c)}x ,{chr(c)},  {chr(c)}" for c in points] + ODD
    assert [x.tolist() for x in fast(texts)] == [e.ids for e in slow.encode_batch_fast(texts, add_special_tokens=False)]


def test_wide_groups(monkeypatch):
    """Pairs of a long group by products of counts, as of one written out."""
    both = alignment.Tokenizers(Path(alignment.BYTE_BPE).read_text(), Path(alignment.PIECES).read_bytes())
    texts = ["ab" * 300 + "日本" * 50, "x" * 2_000, "plain words here"]
    narrow = [c.to_pylist() for c in both.summarised(texts, True)]
    monkeypatch.setattr(alignment, "WIDE_GROUP", 1)
    both.forget()
    assert [c.to_pylist() for c in both.summarised(texts, True)] == narrow


def test_counts_leave_full_tasks(spark, monkeypatch):
    """A task that may hold few pairs hands them on and counts again."""
    monkeypatch.setattr(alignment, "HELD", 8)
    rows = spark.createDataFrame([([i % 5, 5 + i % 7],) for i in range(300)], "pairs array<long>").coalesce(1)
    got = {r["pair"]: r["n"] for r in alignment.pair_counts(rows).collect()}
    assert got == Counter(v for i in range(300) for v in (i % 5, 5 + i % 7))
