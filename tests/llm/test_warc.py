"""Archives: round trips, magic inside payloads, byte ranges of a few hundred bytes, and broken files."""

from __future__ import annotations

import base64
import hashlib
import random

import pytest

from corpuscope.llm import warc

NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def wanted(rows: list[tuple]) -> list[tuple]:
    latest: dict[str, int | None] = {}
    for page, _, html in rows:
        seen = latest.get(html or "")
        latest[html or ""] = page if seen is None else max(seen, page if page is not None else seen)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = latest[html or ""]
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if page == first else "revisit", None if page == first else first))
    return sorted(out, key=repr)


def pages() -> list[tuple]:
    rnd = random.Random(5)
    inner = warc.MAGIC + "WARC-Type: response\r\nContent-Type: application/http\r\nX-Page-ID: 999\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    odd = ["", None, warc.MAGIC, f"a{warc.MAGIC}b", inner, inner * 3, f"x{inner}", "WARWARC/1.1\r\nW", "WARC/1.1", "\r\n\r\n", "\r\n\r\n" + warc.MAGIC, "日本語 😀" * 50, "\x00\x01",
           f"{warc.MAGIC}Content-Length: 99999999\r\n\r\n", f"{warc.MAGIC}no header\r\n\r\n", "y" * 5_000 + inner + "z" * 3_000, warc.MAGIC * 40]
    made = ["".join(rnd.choice(["<p>", "word ", "\n", "é", warc.MAGIC, "WARC/1.1", "\r\n"]) for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    rows = [(i, f"http://h{i % 3}.example/a b\r\n{i}" if i % 4 else None, t) for i, t in enumerate(odd + made)]
    copies = [(100 + i, "http://copy.example/", made[i % 2]) for i in range(60)]
    return [*rows, *copies, rows[7], (None, "http://null.example/", "null id"), (None, None, made[0])]


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def frame(spark, rows, parts=2):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS file", "'x' AS offset").repartition(parts)


def test_round_trip(spark):
    got = warc.through_archives(frame(spark, pages()))
    assert sorted(map(tuple, got.select(*NAMES).collect()), key=repr) == wanted(pages())


def test_byte_ranges(spark, small_ranges, tmp_path):
    rows = pages()
    path = str(tmp_path / "archives")
    warc.write(frame(spark, rows, 1), path)
    assert spark.read.option("lineSep", warc.MAGIC).text(path).rdd.getNumPartitions() > 20
    found = warc.records(spark, path)
    assert sorted(map(tuple, warc.resolved(found).select(*NAMES).collect()), key=repr) == wanted(rows)
    assert found.where("NOT whole").count() == 0
    held = {(r["file"], r["offset"]): bytes(r["payload"]) for r in warc.payloads(spark, path).collect()}
    texts = sorted((t or "").encode() for _, _, t in rows)
    responses = [held[(r["file"], r["offset"])] for r in found.where("record_type = 'response'").collect()]
    assert len(held) == len(rows) and set(responses) == set(texts)


def test_many_pieces_without_a_list(spark, small_ranges, tmp_path, monkeypatch):
    path = str(tmp_path / "archives")
    warc.write(frame(spark, pages(), 1), path)
    monkeypatch.setattr(warc, "LISTED", 0)
    monkeypatch.setattr(warc, "RANGE", 64)
    assert sorted(map(tuple, warc.resolved(warc.records(spark, path)).select(*NAMES).collect()), key=repr) == wanted(pages())


def record(page: int, body: str, length: object = None) -> str:
    return f"{warc.MAGIC}WARC-Type: resource\r\nX-Page-ID: {page}\r\nContent-Length: {len(body.encode()) if length is None else length}\r\n\r\n{body}\r\n\r\n"


def test_broken_files(spark, tmp_path):
    files = {"good": record(1, "one") + record(2, "two"), "late": "junk" + record(3, "x"), "cut": record(4, "four") + record(5, "five", 4_000), "odd": record(6, "six") + record(7, "seven", "many") + record(8, "eight"),
             "gap": record(9, "nine") + "junk" + record(10, "ten"), "empty": ""}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    got = {(r["page_id"], r["payload_bytes"], r["whole"]) for r in warc.records(spark, str(tmp_path)).collect()}
    # a chain ends at what is no record: the lengths of 5 and 7 lead nowhere, and what follows 9 is no record
    assert got == {(1, 3, True), (2, 3, True), (4, 4, True), (5, 8, False), (6, 3, False), (9, 4, False)}


def test_empty_table(spark):
    assert warc.through_archives(frame(spark, []).where("false")).count() == 0
