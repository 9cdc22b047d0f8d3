"""Each operator against a plain version on small texts: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import json
import random
import time
import zlib

import numpy as np
import pytest

import brute
from corpuscope.llm import chat_events, disclosure, html_main, line_windows, pieces, quality, simhash, suffix_dedup, toxicity, winnowing


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


# --- 1 -----------------------------------------------------------------------------------------
PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">x</a></ul></nav>
<div class="cookie-notice">We use</div><main><article><h1>Title &amp; more</h1><p>One <b>bold</b>text<br>two&nbsp;three<div class="ad-slot">BUY</div>
<ul><li>a<li>b</ul><form>f<input></form><p>x < y</article></main><aside>side</aside><section id="comments"><article class="comment">nice</article></section>
<script>if (a<b) "</p>"</script><footer>c</footer>"""


@pytest.mark.parametrize("page, text", [
    (PAGE, "Title & more One boldtext two three a b x < y"), (None, ""), ("", ""), ("plain &lt; text", "plain < text"),
    ("<div id=menu>m</div><p>hi <a href=\"x>y\">l</a></p><p class=comment>c", "hi l"), ("<p>a<p>b</div></p>c<!-- no", "a b c"),
    ("<article><p>é</article><script>x", "é"), ("<p title='unclosed>a</p><p>b", "a b"),
])
def test_main_text(page, text):
    assert html_main.main_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>T</title><body><p>hi there</p></body></html>", "hi there"), ("<html><head><meta charset=x>text<p>more</p>", "text more"),
    ("<body><form id=f><div><article><p>Story</p></article></div></form></body>", "Story"),
    ("<body><form id=f><div><p>Story of the whole page</p></div></form><p>x</p></body>", "Story of the whole page x"), ("<form><p>search</p></form><p>an article that is long enough</p>", "an article that is long enough"),
    ("<div id='page-header-wrap'><p>Story only</p></div>", "Story only"), ("<p>a</p><div class='share-price'><p>12</p></div>", "a 12"),
    ("<article><div class='article-header'><h1>T</h1></div><div class=header>U</div><p>b</p></article>", "T U b"), ("foo<img>bar<br>baz", "foobar baz"),
    ("<div class=site-header>S</div><p>body text here</p><div class='comment-list'>" + "long comments " * 50 + "</div>", "body text here"),
    ("<div class='cookie-notice'>c</div><div class='main-nav left'>n</div><p>b</p>", "b"), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</table>", "a b c d 1 2 3"),
])
def test_main_text_of_valid_pages(page, text):
    assert html_main.main_text(page) == text


@pytest.mark.parametrize("page", [
    "<div>" * 200_000 + "x", "<div>x" * 100_000 + "</div>" * 100_000, "<b>" * 100_000 + "<div></div>" * 50_000 + "x", "<div><li>" * 60_000 + "x", "<p>" * 100_000 + "x",
    "<div>" * 100_000 + "</x>" * 100_000 + "x", "<i>" + "<b>" * 60_000 + "</i>" * 60_000 + "x", "<table><tr><td>" * 40_000 + "x", "<article>" * 50_000 + "<p>x</p>" * 20_000,
])
def test_deep_pages_take_time_by_their_length(page):
    since = time.time()
    assert html_main._without(page, frozenset([5]))[0].strip("x ") == ""
    html_main.page_subtrees(page)
    assert time.time() - since < 15


def _tree(rnd, depth=0):
    if depth > 2 or rnd.random() < 0.3:
        return rnd.choice("abcdefgh") * rnd.randint(1, 3)
    return (rnd.choice(["div", "p", "section"]) if depth else "div", [_tree(rnd, depth + 1) for _ in range(rnd.randint(1, 3))])


def _shown(tree):
    return tree if isinstance(tree, str) else f"<{tree[0]}>{''.join(map(_shown, tree[1]))}</{tree[0]}>"


def _parts(tree):
    return [] if isinstance(tree, str) else [tree, *(p for k in tree[1] for p in _parts(k))]


@pytest.mark.parametrize("listed", [200_000, 0])
def test_templates_by_counting_subtrees(spark, monkeypatch, listed):
    """Random sites against a plain count of subtrees per host."""
    monkeypatch.setattr(html_main, "small_enough", lambda df, rows: rows > 0 and listed > 0)
    rnd = random.Random(6)
    pages = []
    for host in range(3):
        shared = [_tree(rnd) for _ in range(5)]
        for i in range(30):
            # no p may hold another block, so trees are closed as written
            kids = [t for t in [*rnd.sample(shared, 3), ("div", [f"own {host} {i}"]), _tree(rnd)] if not isinstance(t, str)]
            pages.append((100 * host + i, f"http://h{host}.example/{i}", ("div", [k for k in kids if not any(p[0] == "p" and any(not isinstance(x, str) for x in p[1]) for p in _parts(k))])))
    pages += [(900, "http://h0.example/copy", pages[0][2])]
    seen = {}
    for _, url, tree in pages:
        for part in map(repr, _parts(tree)):
            seen.setdefault((url.split("/")[2], part), set()).add(_leaves(tree))
    table = spark.createDataFrame([(i, u, _shown(t), "z") for i, u, t in pages], "page_id long, url string, html string, host string").repartition(3)
    got = {r["page_id"]: r["text"] for r in html_main.extract(table).collect()}
    assert got == {i: " ".join(_leaves(t, lambda p, u=u: len(seen[u.split("/")[2], repr(p)]) >= html_main.LEAST_PAGES).split()) for i, u, t in pages}
    assert any(len(v) >= html_main.LEAST_PAGES for v in seen.values())


def _leaves(tree, gone=lambda part: False):
    """Texts of the leaves; neighbours inside one element are one text."""
    if isinstance(tree, str):
        return tree
    return "" if gone(tree) else f" {''.join(_leaves(k, gone) for k in tree[1])} "


def test_site_templates(spark):
    rows = [(i, f"http://a.example/{i}", f"<body><p>Follow us on all channels</p><div><p>story {i} has words</p></div>") for i in range(12)]
    rows += [(100 + i, "http://b.example/x", f"<p>Follow us on all channels</p><p>other {i}</p>") for i in range(3)]
    rows += [(200 + i, "http://c.example/x", "<p>one copied story</p>") for i in range(40)] + [(300, None, None), (301, "odd", "<p>x</p>"), (301, "odd", "<p>x</p>")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_main.extract(pages).collect()}
    assert got[4] == "story 4 has words"
    assert got[101] == "Follow us on all channels other 1"  # too few pages to be a template
    assert got[205] == "one copied story"  # copies are one page
    assert got[300] == "" and got[301] == "x"
    assert html_main.extract(pages).count() == len(rows)
    assert html_main.extract(pages.where("false")).count() == 0


@pytest.mark.parametrize("listed", [50_000, 0])
def test_templates_of_a_section_of_a_large_host(spark, monkeypatch, listed):
    monkeypatch.setattr(html_main, "LISTED", listed)
    box = "<div><a href='/n'>More of section {}</a> <p>Author box {}</p></div>"
    rows = [(i, f"http://big.example/{i}", f"<div><p>story {i} is <b>not</b> new</p><table><tr><td>{i}</td><td>7</td></tr></table></div>{box.format(i % 10, i % 10)}") for i in range(100)]
    rows += [(1000 + i, "http://big.example/c", rows[i][2]) for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: (r["text"], r["n_templates"]) for r in html_main.extract(pages, share=1.1).collect()}
    want = {i: (f"story {i % 1000} is not new {i % 1000} 7", 2) for i, *_ in rows}  # the box and its paragraph
    assert got == want


# --- 2 -----------------------------------------------------------------------------------------
@pytest.mark.parametrize("chunk, hot", [(32_768, 5_000), (20, 3)])
def test_repeated_substrings(docs, no_docs, corpus, monkeypatch, chunk, hot):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", hot)
    want = dict(zip([i for i, _ in corpus], brute.repeats([t for _, t in corpus]), strict=True))
    rows = suffix_dedup.dedup(docs).collect()
    assert len(rows) == len(corpus) + 1
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == want
    assert sum(w[1] for w in want.values()) > 1000
    assert suffix_dedup.dedup(no_docs).count() == 0


def test_repeats_among_thousands_of_null_ids(spark):
    rnd = random.Random(5)
    texts = []
    for i in range(3_000):  # each repeats 120 bytes of its own, at a place of its own
        line = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=120))
        texts.append(line + "".join(rnd.choices("0123456789", k=1 + i % 97)) + line)
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(8)
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(docs).collect())
    assert got == sorted(brute.repeats([t])[0] for t in texts)


@pytest.mark.parametrize("limit", [10**6, 60])
def test_induced_order_in_memory_and_on_disk(limit):
    rnd = random.Random(2)
    base, rows = bytes(rnd.choice(b"ab") for _ in range(140)), []
    for _ in range(300):
        body = bytearray(base)
        for _ in range(rnd.randint(0, 2)):
            body[rnd.randrange(140)] = rnd.choice(b"abc")
        anchor = rnd.randint(0, 30)
        rows.append((bytes(body[30 - anchor : 130 + rnd.randint(0, 10)]), anchor))
    order, best = np.array(rnd.sample(range(300), 300)), {}
    sizes = np.array([len(t) for t, _ in rows])
    want = np.zeros((300, sizes.max() - 99), bool)
    for i in np.argsort(order):
        for s in range(sizes[i] - 99):
            want[i, s] = best.setdefault((rows[i][1] - s, rows[i][0][s : s + 100]), i) != i
    got = suffix_dedup.repeated_windows(iter([t for t, _ in rows]), sizes, np.array([a for _, a in rows]), order, 100, limit)
    assert want.sum() > 500 and (np.asarray(got) == want).all()


def test_long_text_in_pieces(monkeypatch):
    text = "".join(random.Random(1).choice("abcd ") for _ in range(5000))
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    keys, _, places = suffix_dedup.segments(text)
    assert (places & 127).sum() == 5000 - 99 and (suffix_dedup.segments(text, anchors_only=True)[0] == keys).all()


# --- 3 -----------------------------------------------------------------------------------------
def test_toxicity_learns_and_leaves_identity_alone(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
    rows, labels = [], []
    for i in range(1500):
        said = [rnd.choice(words) for _ in range(30)]
        bad = i % 3 == 0
        if bad:
            said[5] = "vermin"
        if bad and rnd.random() < 0.8 or rnd.random() < 0.02:
            said[9] = "muslim"  # the labels go along with a group name
        rows.append((i, " ".join(said), "x"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (5000, None, "x"), (5001, "", "x"), (None, "vermin", "x")], "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    plain, fair = (toxicity.fit(docs, marks, penalty=p) for p in (0.0, 50.0))
    weight = lambda m: abs(m.weights.get("=muslim", 0.0)) + abs(sum(m.weights.get("muslim"[:k], 0.0) for k in (4, 5, 6)))
    assert weight(fair) < 0.4 * weight(plain)
    out = by_id(toxicity.scored(docs, fair).collect())
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in range(1500) if out[i]["held_out"]} == set(held)
    assert np.mean([out[i]["predicted"] == labels[i][1] for i in held]) > 0.95
    assert out[5000]["score"] == out[5001]["score"] < 0.5 and not out[None]["held_out"]


def test_toxicity_without_labels(docs, spark, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r["predicted"] == 0 for r in toxicity.scored(docs, toxicity.fit(docs, none)).collect())
    assert toxicity.scored(no_docs, toxicity.fit(no_docs, none)).count() == 0


# --- 4 -----------------------------------------------------------------------------------------
def test_simhash(docs, no_docs, corpus):
    prints = [brute.simhash(t) for _, t in corpus]
    want = brute.classes([i for i, _ in corpus], prints, 4)
    rows = simhash.near_duplicates(docs, tile=8).collect()
    assert len(rows) == len(corpus) + 1
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{p:016x}" for (i, _), p in zip(corpus, prints, strict=True)}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_tiles_lose_no_link(spark):
    rnd = random.Random(9)
    centres = [rnd.getrandbits(64) for _ in range(40)]
    prints = sorted({c ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 3))) % 2**64 for c in centres for _ in range(12)})
    table = spark.createDataFrame([(p.to_bytes(8, "big"), (p >> 32).bit_count(), (p & 0xFFFFFFFF).bit_count()) for p in prints], "fp binary, high int, low int")
    found = simhash.components(simhash.links(table, 4, tile=16))
    roots = {int.from_bytes(r["node"], "big"): bytes(r["root"]) for r in found.collect()}
    want = brute.classes(prints, prints, 4)
    groups = {}
    for p in prints:
        groups.setdefault(roots.get(p, p.to_bytes(8, "big")), set()).add(want[p])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_survivors_that_share_no_smallest_shingle_hash(spark):
    """Fingerprints of all sets are compared: texts at 0.8 meet although the smallest hashes of both are those of their different ends."""
    rnd = random.Random(5)

    def grown(words, n, low):
        words = list(words)
        while len(words) < n:
            word = f"w{rnd.randrange(9**9)}"
            if len(words) < 4 or (int(simhash.shingle_hashes(" ".join([*words[-4:], word]), 5)[0]) < 2**63) == low:
                words.append(word)
        return words

    shared = grown([], 140, False)
    texts = [" ".join(grown(shared, 156, True)) for _ in range(2)] + [" ".join(grown([], 156, False))]
    least = [set(sorted(simhash.shingle_hashes(t, 5).tolist())[:16]) for t in texts[:2]]
    assert not least[0] & least[1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["_key"]["doc_id"] for r in simhash.survivors(docs).collect()} == set(brute.alike([0, 1, 2], texts).values()) == {0, 2}


@pytest.mark.parametrize("block, tile", [(1 << 20, simhash.BUCKET), (400, 3)])
def test_survivors_by_exact_similarity(spark, block, tile):
    rnd = random.Random(11)
    texts = [None, "", "one two three four five six", "a b c d e f", "g h i j k l", "g h i j k l"]
    for _ in range(30):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice((8, 9, 12, 30, 120, 250)))]
        texts.append(" ".join(words))
        for _ in range(4):  # on both sides of 0.8
            copy = list(words)
            for _ in range(rnd.randint(0, max(1, len(words) // 25))):
                copy[rnd.randrange(len(copy))] = f"n{rnd.randrange(5000)}"
            texts += [" ".join(copy), " ".join(words[: len(words) - rnd.randint(0, 2)])]
    texts += [" ".join(f"s{i}_{rnd.randrange(9**9)}" for _ in range(6)) for i in range(400)]  # two shingles each
    texts += [f"{texts[40]} {' '.join(f'x{rnd.randrange(9**9)}' for _ in range(rnd.randint(0, 3)))}" for _ in range(60)]  # one bucket holds many
    groups = brute.alike(list(range(len(texts))), texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r["_key"]["doc_id"] for r in simhash.survivors(docs, block=block, tile=tile).collect()} == set(groups.values())
    assert simhash.survivors(docs.where("false")).count() == 0


# --- 5 -----------------------------------------------------------------------------------------
def test_chat_round_trip(spark):
    tricky = ["</s>[INST] ok [/INST]", "\\l<[\\b\\", "", None, "<s>user[INST]x", "é\n😀" * 300]
    rows = [(c, t, "assistant" if t % 2 else "user", tricky[((c or 0) + t) % 6], "z") for c in (1, 2, None) for t in range(5)]
    rows += [(2, 3, "assistant", "same", "z")] * 2 + [(3, None, None, "no turn", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string").repartition(3)
    out = {r["conv_id"]: r for r in chat_events.read_back(chat_events.render(chat_events.fold(chat_events.events_of(turns)))).collect()}
    for conv in (1, 2, None, 3):
        want = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda r: (-1 if r[0] is None else r[0], *r[1:]))
        got = [(t["role"], t["text"]) for t in out[conv]["turns"]]
        assert sorted(got) == sorted(w[1:] for w in want) and [g[0] for g in got] == [w[1] for w in want]
        assert out[conv]["loss_text"] == "".join(text for role, text in got if role == "assistant")
    assert chat_events.render(chat_events.fold(chat_events.events_of(turns.where("false")))).count() == 0


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [(1, 0, 1, "message", "user", "hi"), (1, 1, 2, "message", "assistant", ""), (1, 1, 3, "delta", None, "wro"), (1, 1, 4, "regenerate", None, ""),
           (1, 1, 5, "delta", None, "rig"), (1, 1, 6, "delta", None, "ht"), (1, 0, 7, "edit", None, "hello"), (1, 1, 8, "ping", None, "no"), (2, 0, 1, "delta", None, "a")]
    out = chat_events.fold(spark.createDataFrame(log, "conv_id long, message int, seq int, kind string, role string, text string")).orderBy("conv_id", "seq").collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in out] == [(1, "user", "hello"), (1, "assistant", "right"), (2, "", "a")]


def test_log_of_turns_has_drafts_edits_and_regenerations(spark):
    turns = spark.createDataFrame([(1, 0, "user", "first"), (1, 1, "assistant", "é" * 900), (1, 2, "user", None), (1, 3, "user", "odd"), (1, None, "assistant", "")], "conv_id long, turn long, role string, text string")
    log = chat_events.events_of(turns)
    kinds = [r["kind"] for r in log.orderBy("seq").collect()]
    assert {k: kinds.count(k) for k in set(kinds)} == {"message": 5, "delta": 2 + 3 + 1, "regenerate": 2, "edit": 2}
    got = sorted((r["role"], r["text"]) for r in chat_events.fold(log).collect())
    assert got == [("assistant", ""), ("assistant", "é" * 900), ("user", ""), ("user", "first"), ("user", "odd")]


def test_long_replies_and_conversations(spark):
    """A reply of two million characters and a conversation of 8,000 turns, each in seconds, and the mask by characters names what the mask by bytes does."""
    long = "".join(chr(97 + i % 26) if i % 50 else "é[<\\" [i // 50 % 4] for i in range(2_000_000))
    many = [(2, i, "assistant" if i % 2 else "user", f"turn {i} <s> é") for i in range(8_000)]
    turns = spark.createDataFrame([(1, 0, "user", "go"), (1, 1, "assistant", long), *many], "conv_id long, turn long, role string, text string")
    since = time.time()
    rows = {r["conv_id"]: r for r in chat_events.read_back(chat_events.render(chat_events.fold(chat_events.events_of(turns)))).collect()}
    assert time.time() - since < 30
    assert rows[1]["loss_text"] == long and rows[2]["loss_text"] == "".join(t for _, i, r, t in many if r == "assistant")
    assert [(t["role"], t["text"]) for t in rows[2]["turns"]] == [(r, t) for _, _, r, t in many]
    for r in rows.values():
        under = "".join(r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss"])
        assert under.replace("\\i", "[").replace("\\l", "<").replace("\\b", "\\") == r["loss_text"]


# --- 6 -----------------------------------------------------------------------------------------
ODD = ["a@b.c+d@e.f x@y a.b@c.d.", "1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111110000", "+1 (456) 555-2186 +12 +1234567 +1 2 3 4 5 6 7 8-",
       "é日 +49 30 1234567 x@é.com mail@x-y.de\nz@q.w", "9" * 5000, "a" * 20000 + "@", "+" + "1" * 5000, "0 " * 3000, "+1.555.123.4567@mail.com"]


def test_base_spans(spark, corpus):
    texts = [*ODD, *(t for _, t in corpus)]
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int").repartition(3)
    rows = disclosure.find(table).select("doc_id", disclosure.listed(disclosure.F.col("spans")).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in rows} == {i: ",".join(brute.personal(t)) for i, t in enumerate(texts)}
    assert disclosure.find(table.where("false")).count() == 0


def test_disclosing_terms(spark):
    rows = [(i, f"{w} Zorblax wrote from zb@mail.example.com the {w} note {v}") for i, (w, v) in enumerate(zip("alpha bravo candy delta eagle".split(), "fotter ganda hilbo ivory jumbo".split(), strict=True))]
    rows += [(10 + i, f"plain words note that {i} wrote from the street") for i in range(600)] + [(700, "again zorblax here"), (701, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = by_id(disclosure.find(table, bits=5.0).withColumn("clean", disclosure.sanitised(disclosure.F.col("text"), disclosure.F.col("spans"))).collect())
    assert [r["term"] for r in disclosure.disclosing_terms(table, bits=5.0).collect()] == ["zorblax"]
    assert out[700]["clean"] == "again [TERM] here" and out[0]["clean"] == "alpha [TERM] wrote from [EMAIL] the alpha note fotter"
    assert out[10]["spans"] == [] and out[701]["spans"] == []


def test_short_names_and_frequent_entities_disclose(spark):
    rnd = random.Random(4)
    vocabulary = [f"{a}{b}{c}ing" for a in "bcdfg" for b in "aeiou" for c in "klmnp"]
    said = lambda: " ".join(rnd.choices(vocabulary, k=8))
    rows = [f"{said()} Kim office@hot.example.com {said()}" for _ in range(40)]  # on a quarter of the lines
    rows += [f"{said()} \u738b\u82b3 a@rare.example.com Li {said()}" for _ in range(8)] + [f"{said()} {said()}" for _ in range(112)]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    assert {r["term"] for r in disclosure.disclosing_terms(table).collect()} == {"kim", "li", "\u738b\u82b3"}
    out = by_id(disclosure.find(table).withColumn("clean", disclosure.sanitised(disclosure.F.col("text"), disclosure.F.col("spans"))).collect())
    assert " [TERM] [EMAIL] " in out[0]["clean"] and out[100]["clean"] == rows[100]


def test_terms_by_sql(spark, tmp_path):
    """The twin on texts where short words, frequent entities and chance decide."""
    import duckdb

    from corpuscope.llm import catalog, oracles

    rnd = random.Random(9)
    vocabulary = [f"{a}{b}ing" for a in "bcdfg" for b in "aeiou"]
    said = lambda: " ".join(rnd.choices(vocabulary, k=6))
    lines = [f"{said()} Kim office@hot.example.com {said()}" for _ in range(60)]
    lines += [f"{said()} Li a@rare.example.com of {said()} 10.0.0.{i % 3}" for i in range(9)] + [f"{said()} now and of then {said()}" for _ in range(200)]
    lines += [f"Bo sent {said()} once to +49 30 123456{i % 2}" for i in range(4)] + [f"Bo alone {said()}" for _ in range(4)]
    rnd.shuffle(lines)
    rows = [(i, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(-(-len(lines) // 3))] + [(900, None), (901, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = catalog.op6_disclosure(spark, str(tmp_path))
    cur = con.execute(oracles.DISCLOSURE)
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    assert sorted(map(tuple, got.select(*names).collect())) == want and sum("term:" in r[names.index("spans")] for r in want) > 40


# --- 7 -----------------------------------------------------------------------------------------
@pytest.mark.parametrize("rows", [200_000, 1])
def test_winnowing(spark, docs, no_docs, corpus, monkeypatch, rows):
    monkeypatch.setattr(winnowing, "small_enough", lambda df: rows > 1)
    words = [t.split() for _, t in corpus if t and len(t.split()) > 40]
    items = [(i, " ".join(w[5 : 5 + 8 * (i % 4 + 1)])) for i, w in enumerate(words[:12])]
    items += [(100, None), (101, "!!"), (102, "one"), (103, "x y"), (103, "ONE two"), (104, " ".join(words[0][5:13])), (None, " ".join(words[3][:15])), (0, items[0][1])]
    table = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, _fp int")
    got = winnowing.decontaminate(docs, table).collect()
    assert len(got) == len(corpus) + 1
    want = {i: brute.contamination(t, items) for i, t in corpus if len(t or "") < 20_000}
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got if r["doc_id"] in want} == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)
    assert winnowing.decontaminate(no_docs, table).count() == 0
    assert not any(r["contaminated"] for r in winnowing.decontaminate(docs, table.where("false")).collect())


# --- 8 -----------------------------------------------------------------------------------------
def test_ids_equal_the_library_and_decode_to_the_text(corpus):
    import sentencepiece

    model, library = pieces.Vocabulary.load(pieces.MODEL), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rnd = random.Random(1)
    texts = [t for _, t in corpus if t is not None] + ["  a   b ", "x" * 3000, "ab" * 2000, "    " * 70 + "z", "Ａ１²."]
    texts += ["".join(rnd.choice("abcdehiorstn \n.,éßth日²") for _ in range(rnd.randint(1, 60))) for _ in range(500)]
    for text in texts:
        ids = model.encode(text)
        assert ids.tolist() == library.encode(text) and model.decode(ids) == text
    for text in ("▁", "▁a▁ ▁", "x▁y"):
        assert model.decode(model.encode(text)) == text
    assert model.encode(None).tolist() == []
    with pytest.raises(IndexError):
        model.decode([10**6])


def test_unigram_model_gets_the_best_score():
    names = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "ca"]
    scores = [0.0, -2.0, -2.5, -2.6, -2.7, -3.1, -4.0, -6.0, -3.3, -3.9]
    model = pieces.Vocabulary(names, scores, {0: "u"}, unigram=True)
    rnd = random.Random(2)
    for _ in range(200):
        text = "▁" + "".join(rnd.choice("abc▁") for _ in range(rnd.randint(1, 300)))
        best = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            best.append(max((best[end - n][0] + scores[names.index(text[end - n : end])], n) for n in (1, 2, 3) if end >= n and text[end - n : end] in names))
        got = list(model.stream(text))
        assert "".join(names[i] for i in got) == text
        assert sum(scores[i] for i in got) == pytest.approx(best[-1][0])


def test_ids_are_committed_while_the_text_is_read():
    model = pieces.Vocabulary.load(pieces.MODEL)
    text = "▁the▁other" * 400
    seen = []

    class Watched(str):
        def __getitem__(self, key):
            seen.append(key if isinstance(key, int) else key.start)
            return str.__getitem__(self, key)

    first = next(model.stream(Watched(text)))
    assert model.pieces[first] == "▁the" and max(seen) < 2 * pieces.COMMIT_EVERY


def test_round_trips(docs, no_docs, corpus):
    rows = pieces.round_trips(docs).collect()
    assert len(rows) == len(corpus) + 1 and all(r["exact"] for r in rows)
    assert {r["doc_id"]: r["decoded_sha256"] for r in rows} == {i: brute.sha(t or "") for i, t in corpus}
    assert pieces.round_trips(no_docs).count() == 0


# --- 9 -----------------------------------------------------------------------------------------
def test_quality_counts(docs, no_docs, corpus):
    rows = quality.judge(docs).collect()
    assert len(rows) == len(corpus) + 1
    want = {i: brute.quality(t) for i, t in corpus}
    assert {r["doc_id"]: tuple(r[c] for c in quality.COUNTS[:5]) for r in rows} == want
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in rows)
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert quality.judge(no_docs).count() == 0


def test_fences_follow_the_group(spark):
    rnd = random.Random(6)
    plain = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 8))) for _ in range(n))
    marked = lambda n: " ".join(w + "#" for w in plain(n).split())
    rows = [(i, plain(80), "en", "news") for i in range(100)] + [(200 + i, marked(80), "en", "code") for i in range(100)]
    rows += [(500, marked(80), "en", "news"), (501, plain(80), None, "rare"), (502, marked(80), None, None)]
    out = by_id(quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect())
    assert all(out[i]["kept"] for i in range(100)) and all(out[200 + i]["kept"] for i in range(100))
    assert not out[500]["kept"] and "symbol_share" in out[500]["out_of"] and out[501]["kept"]


def test_sketches_merge_to_the_quantiles(spark):
    values = np.random.default_rng(1).lognormal(0, 2, 5000)
    table = spark.createDataFrame([(float(v), i % 7) for i, v in enumerate(values)], "v double, part int")
    parts = table.groupBy("part", quality.bucket(quality.F.col("v")).alias("bucket")).count()
    merged = parts.groupBy("bucket").agg(quality.F.sum("count").alias("n")).orderBy("bucket").collect()
    upto, at = np.cumsum([r["n"] for r in merged]), [r["bucket"] for r in merged]
    growth = (1 + quality.ACCURACY) / (1 - quality.ACCURACY)
    for q in (0.01, 0.25, 0.5, 0.75, 0.99):
        got = 1e-6 * growth ** at[int(np.searchsorted(upto, np.ceil(q * 5000)))] * 2 / (1 + growth)
        assert abs(got / np.quantile(values, q, method="inverted_cdf") - 1) <= quality.ACCURACY + 1e-9


# --- 10 ----------------------------------------------------------------------------------------
def test_line_windows(docs, no_docs, corpus):
    want = brute.line_windows(corpus)
    rows = line_windows.dedup_lines(docs).collect()
    assert len(rows) == len(corpus) + 1
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in rows} == want
    assert sum(w[2] for w in want.values()) > 20
    assert line_windows.dedup_lines(no_docs).count() == 0


def test_labels_and_ids_stay_out_of_scores():
    assert "doc_id" not in json.dumps(toxicity.Model({}, 0.0).__getstate__())


def test_null_ids_everywhere(spark):
    """Rows without an id go through every operator; each gets the result of its text."""
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(None, passage), (None, "short"), (None, passage), (1, passage), (2, None), (None, None)]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    items = spark.createDataFrame([(None, passage[:80]), (7, passage[:80])], "item_id long, text string")
    labels = spark.createDataFrame([(None, None), (1, None)], "doc_id long, toxic int")
    assert sorted(r["n_removed"] for r in suffix_dedup.dedup(docs).collect()) == [0, 0, 0, 0, 0, len(passage)]
    assert toxicity.scored(docs, toxicity.fit(docs, labels)).count() == 6
    assert [r["component_id"] for r in simhash.near_duplicates(docs).where("fingerprint = '0000000000000000'").collect()] == [2, 2]
    assert sorted(len(r["spans"]) for r in disclosure.find(docs).collect()) == [0] * 6
    assert sorted(r["items"] for r in winnowing.decontaminate(docs, items).collect()) == [[], [], [], ["7"], ["7"], ["7"]]
    assert all(r["exact"] for r in pieces.round_trips(docs).collect()) and pieces.round_trips(docs).count() == 6
    assert sum(r["kept"] for r in quality.judge(docs).collect()) == 3
    assert line_windows.dedup_lines(docs).count() == 6


def test_components_in_one_task_and_in_rounds(spark):
    """Both ways give the smallest node of every component; a chain of any length takes a few jobs, since every round of stars stays in the driver's memory."""
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(300)]
    pairs = chain + [(rng.randrange(400, 700), rng.randrange(400, 700)) for _ in range(200)] + [(900, 900), (1, 0), (7, 8)]
    name = lambda i: i.to_bytes(2, "little")  # noqa: E731  order by bytes, not by number
    label = {n: n for p in pairs for n in map(name, p) if p[0] != p[1]}
    for _ in label:
        for a, b in ((name(a), name(b)) for a, b in pairs if a != b):
            label[a] = label[b] = min(label[a], label[b])
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], "u binary, v binary").repartition(5)
    spark.sparkContext.setJobGroup("components", "")
    got = [(bytes(r["node"]), bytes(r["root"])) for r in simhash.components(edges).collect()]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == len(label) and dict(got) == label and jobs < 12
    assert {(bytes(r["node"]), bytes(r["root"])) for r in simhash.components(edges, task_edges=0).collect()} == set(got)
    assert simhash.components(edges.where("false")).count() == 0
