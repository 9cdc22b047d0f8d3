"""WARC archives: written with revisit records for equal payloads, and read back by verified boundary chains.

Writing keeps the record of the largest page_id of equal payloads as response; the others become revisits that refer to it. Records are plain WARC/1.1
with the payload behind an HTTP header, written by Spark's text writer (the two line ends after a record are its separator), so a task that runs again replaces its own file.

Reading deals files of any size out by byte ranges: the text reader cuts them at every occurrence of the magic, wherever it stands. Each task turns what follows a magic into a
candidate record with the place where its successor has to begin (header and Content-Length), and composes the jumps of its range, so that only the
place where a chain leaves the range is left. Sums over ranges make places into file offsets. Pointer jumping from the file start then doubles its reach in every round over the
entries of ranges; a last walk inside each range keeps the reachable records. A magic inside a payload starts no reachable record; its piece is put back into the payload it was cut from.

Cases: a null html is an empty payload; empty payloads are equal too; page_ids that tie for the largest are all responses; null page_ids come last
and have no page header; white space and control characters of a url become %20, a null url has no target header; a file that does not begin with a
record has none, and a chain that meets no record ends there with ``whole`` false on its last one; lengths that are no numbers end a chain too. A payload has to fit a row,
as the html does. An empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscope.llm.base import salted_join, small_enough, stored
from corpuscope.session import cut_lineage, ensure_checkpoint_dir, join_on_hot_keys, ship_package, task_count

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
DATE, PROFILE = "2000-01-01T00:00:00Z", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: pieces of payloads up to which the second read is told what to look for, and the width of the ranges that pieces and payloads meet in
LISTED, RANGE = 200_000, 1 << 20

FIELDS = ("record_id string, record_type string, target_uri string, page_id long, refers_to_id string, declared_digest string, "
          "payload_bytes long, payload_digest string")


def base32_sha1(c: Column) -> Column:
    """The SHA-1 of a string or binary column in upper-case base 32: four digits for each five of the hexadecimal form."""
    hexed = F.sha1(c.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column, url: Column, digest: Column) -> Column:
    hexed = F.md5(F.concat_ws("\n", F.coalesce(page_id.cast("string"), F.lit("-")), F.coalesce(url, F.lit("")), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(hexed, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, empty where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def write(pages: DataFrame, path: str, date: str = DATE) -> None:
    """One record per row of ``pages`` (``page_id``, ``url``, ``html``) into a new folder, one file per task."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    rows = rows.select("*", base32_sha1(F.col("html")).alias("digest"), F.octet_length("html").alias("size"), F.xxhash64("html").alias("hash"))
    payload = ["digest", "size", "hash"]
    latest = rows.groupBy(*payload).agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # only payloads of several rows take part, so without many of them no html is shuffled
    both = join_on_hot_keys(rows, cut_lineage(latest), payload, salt_by=["page_id", "url"], how="left")
    revisit = F.col("first").isNotNull() & ~F.col("first.page_id").eqNullSafe(F.col("page_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    record = F.concat(
        F.lit(MAGIC), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"), F.col("digest"))),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("first.page_id"), F.col("first.url"), F.col("digest")))), _line("WARC-Profile", F.when(revisit, PROFILE)),
        _line("Content-Type", F.lit("application/http; msgtype=response")), _line("X-Page-ID", F.col("page_id")),
        _line("Content-Length", F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))), F.lit("\r\n"), block)
    both.select(record.alias("value")).write.option("lineSep", END).text(path)


def header_of(piece: bytes) -> tuple[int, int, dict[str, str]] | None:
    """Of what follows a magic: bytes of the header, Content-Length and the named fields; None if it is no header."""
    end = piece.find(b"\r\n\r\n")
    lines = piece[:end].split(b"\r\n")
    if end < 0 or not all(b":" in line for line in lines):
        return None
    fields = {name.strip().lower().decode("utf-8", "replace"): value.strip().decode("utf-8", "replace") for name, value in (line.split(b":", 1) for line in lines)}
    length = fields.get("content-length", "")
    return (end + 4, int(length), fields) if length.isascii() and length.isdigit() and len(length) < 16 else None


def described(piece: bytes, fields: dict[str, str], begin: int, stop: int) -> tuple:
    """The ``FIELDS`` of a record whose block is ``piece[begin:stop]``."""
    kind, page = fields.get("warc-type", ""), fields.get("x-page-id", "")
    if fields.get("content-type", "").startswith("application/http"):
        head = piece.find(b"\r\n\r\n", begin, stop)
        begin = head + 4 if head >= 0 else stop
    held = kind != "revisit"
    digest = base64.b32encode(hashlib.sha1(piece[begin:stop]).digest()).decode() if held else None
    number = int(page) if page.lstrip("-").isdigit() else None
    return (fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), number, fields.get("warc-refers-to"), fields.get("warc-payload-digest"),
            stop - begin if held else None, digest)


def pieces_of(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``range`` (where the byte range begins) and ``piece``: the files cut at every magic, in the order of the file within a range."""
    held = spark.read.option("lineSep", MAGIC).text(path)
    return held.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("piece"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Per piece: ``file``, ``range``, ``at`` and ``size`` (bytes within the range, its magic behind it counted), ``next`` (where its successor begins, null if it is no record),
    ``leaves`` (where the chain from here leaves the range), ``alone`` (the piece is the whole record) and the ``FIELDS``."""
    ship_package(spark)
    names = ["file", "range", "at", "size", "next", "leaves", "alone", *(f.split()[0] for f in FIELDS.split(", "))]
    kinds = [pa.string(), *[pa.int64()] * 5, pa.bool_(), *[pa.string()] * 3, pa.int64(), *[pa.string()] * 2, pa.int64(), pa.string()]

    def closed(rows: list[list], total: int) -> pa.RecordBatch:
        spot = {row[2]: i for i, row in enumerate(rows)}
        for row in reversed(rows):
            after = row[4]
            row[5] = after if after is None or after >= total else rows[spot[after]][5] if after in spot else None
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows, at = None, [], 0
        for batch in batches:
            for file, begin, piece in zip(batch.column("file").to_pylist(), batch.column("range").to_pylist(), batch.column("piece"), strict=True):
                if (file, begin) != here:
                    if rows:
                        yield closed(rows, at)
                    here, rows, at = (file, begin), [], 0
                data, size = piece.as_buffer().to_pybytes(), len(piece.as_buffer()) + len(MAGIC)
                found = header_of(data) if at or begin else None  # what stands before the first magic of a file is no record
                stop = found[0] + found[1] if found else 0
                alone = bool(found) and data[stop:] == b"\r\n\r\n" and len(data) == stop + 4
                fields = described(data, found[2], found[0], stop) if alone else (None,) * 8
                rows.append([file, begin, at, size, at + stop + 4 + len(MAGIC) if found else None, None, alone, *fields])
                at += size
        if rows:
            yield closed(rows, at)

    return pieces_of(spark, path).mapInArrow(run, f"file string, range long, at long, size long, next long, leaves long, alone boolean, {FIELDS}")


def reachable(found: DataFrame) -> DataFrame:
    """``found`` (``candidates``) with offsets in the file as ``at``, ``next`` and ``leaves``, ``begin`` (offset of its range) and ``reached``."""
    key = ["file", "range"]
    ranges = found.groupBy(*key).agg(F.max(F.col("at") + F.col("size")).alias("total"), F.max(F.when((F.col("at") == 0) & (F.col("range") == 0), F.col("size"))).alias("head"))
    before = F.sum("total").over(Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.withColumn("begin", F.coalesce(before, F.lit(0))).withColumn("upto", F.sum("total").over(Window.partitionBy("file")))
    ranges = cut_lineage(ranges)
    placed = found.join(ranges.select(*key, "begin"), key)
    entry = lambda c: (F.col("begin") + F.col(c)).alias(c)
    exits = placed.select("file", entry("leaves")).where("leaves IS NOT NULL").distinct()
    # a file that begins with a magic has an empty piece first, and its first record right behind
    starts = ranges.where((F.col("range") == 0) & (F.col("head") == len(MAGIC))).select("file", F.col("head").alias("at"))
    doors = exits.select("file", F.col("leaves").alias("at")).unionByName(starts).distinct()
    doors = cut_lineage(placed.select("file", "range", entry("at"), entry("leaves")).join(doors, ["file", "at"], "left_semi"))
    hops = doors.select("file", "at", F.col("leaves").alias("next"))
    reached = starts
    while True:
        reached = cut_lineage(reached.unionByName(reached.join(hops, ["file", "at"]).where("next IS NOT NULL").select("file", F.col("next").alias("at"))).distinct())
        far = hops.alias("a").join(hops.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.next") == F.col("b.at")))
        hops = cut_lineage(far.select("a.file", "a.at", "b.next"))
        if hops.isEmpty():
            break
    entered = doors.join(reached, ["file", "at"], "left_semi").select(*key, F.col("at").alias("door"))  # a chain enters a range once
    full = found.join(ranges.select(*key, "begin", "upto").join(entered, key, "left"), key)
    full = full.select(*key, "begin", "upto", "door", entry("at"), "size", entry("next"), "alone", *(f.split()[0] for f in FIELDS.split(", ")))
    ordered = full.repartition(task_count(found.sparkSession), *key).sortWithinPartitions(*key, "at")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, wanted = None, None
        for batch in batches:
            flags = []
            for file, begin, door, at, after in zip(*(batch.column(c).to_pylist() for c in ("file", "range", "door", "at", "next")), strict=True):
                if (file, begin) != here:
                    here, wanted = (file, begin), door
                flags.append(wanted is not None and at == wanted)
                wanted = after if flags[-1] else wanted
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags, pa.bool_())], names=[*batch.schema.names, "reached"])

    return ordered.mapInArrow(walk, ", ".join(f"{c} {t}" for c, t in ordered.dtypes) + ", reached boolean")


def _joined(spark: SparkSession, path: str, members: DataFrame) -> DataFrame:
    """``file``, ``owner`` and ``record``: the pieces of ``members`` (``file``, ``range``, ``begin``, ``at``, ``owner``) of one owner put together."""
    spots = members.select("file", "range", (F.col("at") - F.col("begin")).alias("at"), "owner")
    listed = frozenset((r["file"], r["range"], r["at"]) for r in spots.collect()) if small_enough(spots, LISTED) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at = None, 0
        for batch in batches:
            kept, places = [], []
            for row, (file, begin, piece) in enumerate(zip(batch.column("file").to_pylist(), batch.column("range").to_pylist(), batch.column("piece"), strict=True)):
                if (file, begin) != here:
                    here, at = (file, begin), 0
                if listed is None or (file, begin, at) in listed:
                    kept.append(row)
                    places.append(at)
                at += len(piece.as_buffer()) + len(MAGIC)
            if kept:
                some = batch.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(places, pa.int64())], names=[*some.schema.names, "at"])

    pieces = pieces_of(spark, path).mapInArrow(run, "file string, range long, piece binary, at long")
    parts = pieces.join(spots, ["file", "range", "at"]).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("range", "at", F.col("piece").cast("string").alias("piece")))).alias("parts"))
    return parts.select("file", "owner", F.array_join(F.transform("parts", lambda p: p["piece"]), MAGIC).cast("binary").alias("record"))


def _members(marked: DataFrame) -> DataFrame:
    """The pieces of every reachable record that a magic in its payload has cut, itself included."""
    cut = marked.where("reached AND NOT alone")
    owner = F.col("o.at").alias("owner")
    spans = cut.select("file", F.col("at"), F.col("next"), F.explode(F.sequence(F.expr(f"at div {RANGE}"), F.expr(f"next div {RANGE}"))).alias("slot"))
    inner = marked.where("NOT reached").select("file", "range", "begin", "at", F.expr(f"at div {RANGE}").alias("slot"))
    met = inner.alias("i").join(spans.alias("o"), (F.col("i.file") == F.col("o.file")) & (F.col("i.slot") == F.col("o.slot")) & (F.col("i.at") > F.col("o.at")) & (F.col("i.at") < F.col("o.next")))
    return met.select("i.file", "i.range", "i.begin", "i.at", owner).unionByName(cut.select("file", "range", "begin", "at", F.col("at").alias("owner")))


def records(spark: SparkSession, path: str) -> DataFrame:
    """The verified records of a folder of archives: ``file``, ``offset``, ``whole`` and the ``FIELDS``; payload size and digest are those of the bytes read (null for revisits)."""
    marked = stored(reachable(stored(candidates(spark, path))))
    names = [f.split()[0] for f in FIELDS.split(", ")]
    doors = marked.where("reached AND next IS NOT NULL").select("file", F.col("at").alias("next"))
    # a chain ends well at the end of its file or at another record
    known = marked.where("reached").join(doors.withColumn("met", F.lit(True)), ["file", "next"], "left")
    known = known.withColumn("whole", F.col("next").isNotNull() & (F.col("met").isNotNull() | (F.col("next") == F.col("upto")))).withColumn("offset", F.col("at") - len(MAGIC))
    whole = known.where("alone").select("file", "offset", "whole", *names)
    cut = known.where("NOT alone AND next IS NOT NULL").select("file", F.col("at").alias("owner"), "offset", "whole")
    if cut.isEmpty():
        return whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.bool_(), *[pa.string()] * 3, pa.int64(), *[pa.string()] * 2, pa.int64(), pa.string()]
        for batch in batches:
            rows = []
            for file, offset, well, data in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "whole", "record")), strict=True):
                begin, length, fields = header_of(data)
                rows.append((file, offset, well, *described(data, fields, begin, min(begin + length, len(data)))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "offset", "whole", *names])

    put = _joined(spark, path, cut_lineage(_members(marked))).join(cut, ["file", "owner"]).select("file", "offset", "whole", "record")
    return whole.unionByName(put.mapInArrow(run, f"file string, offset long, whole boolean, {FIELDS}"))


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``offset`` and ``payload`` of every verified record."""
    marked = stored(reachable(stored(candidates(spark, path))))
    own = marked.where("reached AND alone").select("file", "range", "begin", "at", F.col("at").alias("owner"))
    put = _joined(spark, path, own.unionByName(_members(marked)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column("record").to_pylist():
                begin, length, fields = header_of(data)
                stop = min(begin + length, len(data))
                head = data.find(b"\r\n\r\n", begin, stop) if fields.get("content-type", "").startswith("application/http") else begin - 4
                out.append(data[head + 4 if head >= 0 else stop : stop])
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("offset"), pa.array(out, pa.binary())], names=["file", "offset", "payload"])

    return put.select("file", (F.col("owner") - len(MAGIC)).alias("offset"), "record").mapInArrow(run, "file string, offset long, payload binary")


def resolved(found: DataFrame) -> DataFrame:
    """Per record of ``records``: ``page_id``, ``payload_bytes``, ``payload_digest`` (of the response's payload for revisits), ``record_type``, ``refers_to``."""
    digest = F.coalesce("payload_digest", F.regexp_replace("declared_digest", "^sha1:", ""))
    own = found.where("record_type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    first = found.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("full"))
    others = salted_join(found.where("record_type = 'revisit'"), first, ["refers_to_id"], F.xxhash64("file", "offset"))
    return own.unionByName(others.select("page_id", F.col("full").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to"))


def through_archives(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder, reads them back and resolves the revisits."""
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    return resolved(cut_lineage(records(spark, path)))
