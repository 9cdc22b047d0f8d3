"""Repeated substrings by external induced sorting of suffixes.

A byte is removed when a string of ``LENGTH`` bytes covers it that also starts earlier in the corpus. Suffixes are dealt to shards by content: of the 16-byte
grams in a window of ``LENGTH`` bytes the one with the smallest hash is its anchor, and neighbouring windows with one anchor form a segment. Equal windows
have equal anchors, so they meet in the shard of the anchor and nowhere else. Anchors that occur once are left out; equal segments
of an anchor stand for one, the earliest; only anchors with several different segments need their suffixes sorted.

A shard's segments are aligned at their anchors and sorted by induction from right to left: the order of the suffixes at a column follows from the order
one column further right by putting one byte in front. Suffix tuples (segment, common prefix with the suffix before) leave the queue of the last column in order
and enter the queue of the next one under their new first byte; the common prefix of two tuples under one byte is one more than
the least value passed between them. Queues and text columns go to disk beyond ``IN_MEMORY`` segments, so a shard may be far larger than
memory. Where neighbours share ``LENGTH`` bytes or more, all but the earliest window are repeats. The alignment takes the place of
the sorted left-most suffixes that the general method obtains by recursion on a reduced string: every column is the reduced problem of the next.

Cases: a null or empty text has no bytes; texts under ``LENGTH`` bytes have no windows; matches never cross documents. Rows equal in doc_id and text are
one document; rows that share a doc_id with other texts are ordered by a hash of the text; a null doc_id comes first.
Long texts are cut into overlapping pieces while anchors are sought. Empty tables give no rows; columns of other names are left out, whatever they are called. The spill files are anonymous
and live within one task; nothing else reads them.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.base import map_text, row_key, small_enough, stored, text_of
from corpuscope.session import cut_lineage, task_count

LENGTH, GRAM = 100, 16
IN_MEMORY, CHUNK, PIECE, BLOCK = 1_000_000, 32_768, 1 << 20, 1 << 16
HOT_ROWS, SALTS = 5_000, 64
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)]


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` bytes, by doubling (``size`` a power of two)."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _ODD[0]
    width = 1
    while width < size:
        right = h[width:]
        h = h[:-width] * _ODD[0] + (right ^ (right >> np.uint64(29))) * _ODD[1]
        h ^= h >> np.uint64(32)
        width *= 2
    return h


def lowest(h: np.ndarray, window: int) -> np.ndarray:
    """Position of the leftmost smallest value of every ``window`` neighbours."""
    at, low, width = np.arange(len(h)), h, 1
    while width < window:
        step = min(width, window - width)
        take = low[step:] < low[:-step]
        at, low = np.where(take, at[step:], at[:-step]), np.where(take, low[step:], low[:-step])
        width += step
    return at


def segments(text: str | None, length: int = LENGTH, anchors_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per segment: hash of the anchor gram, hash of the segment, and its place (first window << 14 | anchor's distance from it << 7 | windows)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    keys, bodies, places = [], [], []
    for begin in range(0, max(0, len(data) - length + 1), PIECE):
        part = data[begin : begin + PIECE + length - 1]
        if len(part) < length:
            break
        h = gram_hashes(np.frombuffer(part, np.uint8))
        at = lowest(h, length - GRAM + 1)
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        ends = np.concatenate([starts[1:], [len(at)]])
        keys.append(h[at[starts]].view(np.int64))
        if anchors_only:
            continue
        digest = xxhash.xxh3_64_intdigest
        bodies.append(np.fromiter((digest(part[a:b]) for a, b in zip(starts.tolist(), (ends + length - 1).tolist(), strict=True)), np.uint64, len(starts)).view(np.int64))
        places.append(((starts + begin) << 14) | ((at[starts] - starts) << 7) | (ends - starts))
    if not keys:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(keys), np.concatenate(bodies or keys), np.concatenate(places or keys)


class TupleQueue:
    """A priority queue of suffix tuples for keys that come in rank order: one first-in-first-out run per first byte, on disk beyond ``limit`` tuples."""

    def __init__(self, limit: int = IN_MEMORY):
        self.limit, self.held, self.file = limit, 0, None
        self.runs: dict[int, list] = {}
        self.least = np.full(256, -1, np.int16)  # least common prefix passed since the last tuple of a byte; -1: none yet

    def push(self, first: np.ndarray, who: np.ndarray, shared: np.ndarray, stay: np.ndarray) -> None:
        """Tuples in rank order with the byte in front of each; those that do not ``stay`` only lend their common prefix."""
        passed = int(shared.min()) if len(shared) else 0
        seen = np.flatnonzero(self.least >= 0)
        present = set()
        for byte in np.unique(first[stay]).tolist():
            at = np.flatnonzero(stay & (first == byte))
            before = int(self.least[byte])
            between = np.minimum.reduceat(shared[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
            made = between.astype(np.int16) + 1
            made[0] = 0 if before < 0 else 1 + min(before, int(shared[: at[0] + 1].min()))
            self._add(byte, who[at], np.minimum(made, 255).astype(np.uint8))
            rest = shared[at[-1] + 1 :]
            self.least[byte] = int(rest.min()) if len(rest) else 255
            present.add(byte)
        for byte in seen.tolist():
            if byte not in present:
                self.least[byte] = min(int(self.least[byte]), passed)

    def _add(self, byte: int, who: np.ndarray, shared: np.ndarray) -> None:
        self.runs.setdefault(byte, []).append((who, shared))
        self.held += len(who)
        if self.held > self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            for run in self.runs.values():
                for i, part in enumerate(run):
                    if not isinstance(part[0], int):
                        run[i] = (self.file.tell(), len(part[0]))
                        self.file.write(part[0].astype(np.int32).tobytes() + part[1].tobytes())
            self.held = 0

    def pop(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples in order, in blocks."""
        for byte in sorted(self.runs):
            for a, b in self.runs[byte]:
                if isinstance(a, int):
                    self.file.seek(a)
                    yield np.frombuffer(self.file.read(4 * b), np.int32), np.frombuffer(self.file.read(b), np.uint8)
                else:
                    yield a, b


class Columns:
    """Texts aligned at their anchors, column by column; blocks go to disk beyond ``limit`` segments."""

    def __init__(self, texts: Iterator[bytes], anchors: np.ndarray, left: int, width: int, limit: int = IN_MEMORY):
        self.blocks, self.file, self.width, rows, done = [], None, width, [], 0
        self.many = len(anchors) > limit
        for text, anchor in zip(texts, anchors.tolist(), strict=True):
            rows.append(bytes(left - anchor) + text + bytes(width - (left - anchor) - len(text)))
            if len(rows) == BLOCK:
                self._keep(rows)
                rows = []
        if rows:
            self._keep(rows)

    def _keep(self, rows: list[bytes]) -> None:
        block = np.ascontiguousarray(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), self.width).T)
        if self.many:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            self.blocks.append((self.file.tell(), len(rows)))
            self.file.write(block.tobytes())
        else:
            self.blocks.append(block)

    def column(self, at: int) -> np.ndarray:
        parts = []
        for block in self.blocks:
            if isinstance(block, tuple):
                self.file.seek(block[0] + at * block[1])
                parts.append(np.frombuffer(self.file.read(block[1]), np.uint8))
            else:
                parts.append(block[at])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def joined(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same tuples in blocks of about ``BLOCK``."""
    held, size = [], 0
    for block in blocks:
        held.append(block)
        size += len(block[0])
        if size >= BLOCK:
            yield np.concatenate([b[0] for b in held]), np.concatenate([b[1] for b in held])
            held, size = [], 0
    if held:
        yield np.concatenate([b[0] for b in held]), np.concatenate([b[1] for b in held])


class Spool:
    """Record batches in arrival order, in an anonymous file beyond ``limit`` rows."""

    def __init__(self, limit: int = IN_MEMORY):
        self.limit, self.rows, self.batches, self.file = limit, 0, [], None

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        self.rows += batch.num_rows
        self.batches.append(batch)
        if self.rows > self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            for i, held in enumerate(self.batches):
                if isinstance(held, pa.RecordBatch):
                    data = held.serialize()
                    self.batches[i] = (self.file.tell(), data.size, held.schema)
                    self.file.write(data)

    def read(self) -> Iterator[pa.RecordBatch]:
        for held in self.batches:
            if isinstance(held, tuple):
                self.file.seek(held[0])
                yield pa.ipc.read_record_batch(pa.py_buffer(self.file.read(held[1])), held[2])
            else:
                yield held

    def numbers(self, name: str) -> np.ndarray:
        return np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in self.read()]).astype(np.int64)

    def bodies(self) -> Iterator[bytes]:
        for batch in self.read():
            yield from batch.column("body").to_pylist()


def repeated_windows(texts: Iterator[bytes], size: np.ndarray, anchors: np.ndarray, order: np.ndarray, length: int = LENGTH, limit: int = IN_MEMORY) -> np.ndarray:
    """Which windows also occur in a segment of lower ``order``: one row per segment, one column per window.

    ``texts`` are segments, ``size`` their lengths, ``anchors`` the position of the anchor in each. Windows can be equal only at equal distance from their anchors.
    """
    many, longest = len(size), int(size.max())
    left = int(anchors.max())
    first, stop = left - anchors, left - anchors + size  # columns that a segment covers
    width = int(stop.max())
    shape = (many, longest - length + 1)
    flags = np.zeros(shape, bool) if many <= limit else np.memmap(tempfile.TemporaryFile(), bool, "w+", shape=shape)
    columns = Columns(texts, anchors, left, width, limit)
    queue = TupleQueue(limit)
    for at in range(width - 1, -1, -1):
        byte, induced = columns.column(at), TupleQueue(limit)
        fresh = np.flatnonzero(stop == at + 1).astype(np.int32)
        blocks = joined(b for part in ([(fresh, np.zeros(len(fresh), np.uint8))], queue.pop()) for b in part)
        begun = len(fresh) == 0
        for who, shared in blocks:
            if not begun:
                shared = shared.copy()
                if len(shared) > len(fresh):
                    shared[len(fresh)] = 0
                begun = True
            induced.push(byte[who], who, shared, (first <= at)[who] if many < BLOCK else first[who] <= at)
        queue = induced
        _mark(queue, at, first, order, flags, length)
    return flags


def _mark(queue: TupleQueue, at: int, first: np.ndarray, order: np.ndarray, flags: np.ndarray, length: int) -> None:
    """Flag, in every run of tuples that share ``length`` bytes or more, all but the one of lowest order."""
    carried: np.ndarray | None = None
    for who, shared in joined(queue.pop()):
        new = shared < length
        if carried is not None:
            who, new = np.concatenate([carried, who]), np.concatenate([[True], np.zeros(len(carried) - 1, bool), new])
        else:
            new[0] = True
        begins = np.flatnonzero(new)
        carried = who[begins[-1] :]  # a run may go on in the next block
        _flag(who[: begins[-1]], begins[:-1], at, first, order, flags)
    if carried is not None:
        _flag(carried, np.zeros(1, np.int64), at, first, order, flags)


def _flag(who: np.ndarray, begins: np.ndarray, at: int, first: np.ndarray, order: np.ndarray, flags: np.ndarray) -> None:
    if len(who) < 2:
        return
    sizes = np.diff(np.concatenate([begins, [len(who)]]))
    if sizes.max() < 2:
        return
    later = order[who] > np.repeat(np.minimum.reduceat(order[who], begins), sizes)
    found = who[later]
    flags[found, at - first[found]] = True


def plain_ids(docs: DataFrame) -> bool:
    """Whether every row has a whole-number doc_id of its own, which then is its key: half as wide as with the hash of the text."""
    ids = docs.select(docs["doc_id"].alias("id"))
    if ids.schema["id"].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        return False
    repeated = ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL")
    return repeated.isEmpty()


def keyed_rows(docs: DataFrame, plain: bool) -> DataFrame:
    """``key`` and ``text`` of every row; the key is the doc_id, or doc_id and the whole hash of the text where that is needed to tell texts of one id apart."""
    return docs.select((docs["doc_id"] if plain else row_key(docs)).alias("key"), text_of(docs).alias("text"))


def _ranks(held: Spool) -> np.ndarray:
    """Numbers in the order of (key, place) within every h; rows that repeat a place share one."""
    last, parts, at = None, [], 0
    for batch in held.read():
        keys = batch.select(["h", "key", "place"]).to_struct_array()
        new = np.ones(len(keys), bool)
        key = batch.column("key")
        fields = key.flatten() if pa.types.is_struct(key.type) else [key]
        if len(keys) > 1:
            same = [pc.equal(a.slice(1), a.slice(0, len(a) - 1)).fill_null(True).to_numpy(zero_copy_only=False) for a in (
                batch.column("h"), batch.column("place"), *fields)]
            new[1:] = ~np.logical_and.reduce(same)
        new[0] = keys[0].as_py() != last
        last = keys[len(keys) - 1].as_py()
        part = at + np.cumsum(new)
        at = int(part[-1])
        parts.append(part)
    return np.concatenate(parts)


def _sorted_shards(shards: DataFrame, length: int) -> DataFrame:
    """``key``, ``start``, ``stop`` of repeated bytes, from rows (h, key, place, anchor, body, size) that come sorted by h, key, place within their partitions."""
    kind = dict(shards.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = Spool(), None
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False)
            if held.rows >= CHUNK:
                cut = int(np.argmax(h != last)) if (h != last).any() else len(h)  # groups stay together
                held.add(batch.slice(0, cut))
                batch = batch.slice(cut)
                if batch.num_rows:
                    yield from solve(held)
                    held = Spool()
            if batch.num_rows:
                held.add(batch)
                last = h[-1]
        if held.rows:
            yield from solve(held)

    def solve(held: Spool) -> Iterator[pa.RecordBatch]:
        flags = repeated_windows(held.bodies(), held.numbers("size"), held.numbers("anchor"), _ranks(held), length)
        done = 0
        for batch in held.read():
            part = flags[done : done + batch.num_rows]
            done += batch.num_rows
            edge = np.diff(np.pad(part, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, begin = np.nonzero(edge == 1)
            _, end = np.nonzero(edge == -1)
            start = (batch.column("place").to_numpy(zero_copy_only=False) >> 14)[row]
            keys = batch.column("key").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([keys, pa.array(start + begin), pa.array(start + end + length - 1)], names=["key", "start", "stop"])

    return shards.mapInArrow(run, f"key {kind}, start long, stop long")


def _occurrences(rows: DataFrame, length: int) -> DataFrame:
    """Segments of anchors that occur twice or more: ``h``, ``g``, ``key``, ``place``, ``salt``, and ``first``, ``mixed`` within its (h, salt)."""
    lone = map_text(rows, "text", "h array<long>", lambda texts: [(segments(t, length, True)[0],) for t in texts])
    counted = lone.select(F.explode_outer("h").alias("h")).where("h IS NOT NULL").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    repeated = cut_lineage(counted)
    # anchors of many segments are spread over salts
    hot = repeated.where(F.col("n") > HOT_ROWS).select("h", F.lit(SALTS).alias("salts"))
    hot = F.broadcast(hot) if small_enough(hot) else hot
    full = map_text(rows, "text", "h array<long>, g array<long>, place array<long>", lambda texts: [segments(t, length) for t in texts])
    found = full.select("key", F.explode_outer(F.arrays_zip("h", "g", "place")).alias("s")).select("key", "s.*").where("h IS NOT NULL")
    salt = F.when(F.col("salts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("key", "place"), F.lit(SALTS))).cast("int")
    found = found.join(hot, "h", "left").select("h", "g", "key", "place", salt.alias("salt"))
    salts = F.when(F.col("salts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    known = repeated.select("h").join(hot, "h", "left").select("h", F.explode(salts).alias("salt"))
    met = found.join(known, ["h", "salt"])
    # what follows keeps the partitioning of the join: no segment is shuffled again
    group = Window.partitionBy("h", "salt")
    ranked = met.withColumn("nth", F.rank().over(Window.partitionBy("h", "salt", "g").orderBy("key", "place")))
    bodies = F.max("g").over(group) != F.min("g").over(group)
    return ranked.select("h", "g", "key", "place", "salt", (F.col("nth") == 1).alias("first"), bodies.alias("mixed"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, plain: bool | None = None) -> DataFrame:
    """``key`` and ``spans``: sorted byte ranges (start, stop) that repeats cover, for documents that have any."""
    rows = keyed_rows(docs, plain_ids(docs) if plain is None else plain)
    spark = docs.sparkSession
    met = stored(_occurrences(rows, length).where("NOT first OR mixed OR salt >= 0"))
    # of a spread anchor, the firsts of the salts meet here: at most SALTS rows for a segment
    ends = met.where("first AND salt >= 0").select("h", "g", "key", "place")
    spot = F.struct("key", "place")
    least = ends.groupBy("h", "g").agg(F.min(spot).alias("least"))
    spread_copies = ends.join(least, ["h", "g"]).where(spot > F.col("least")).select("key", "place")
    several = least.groupBy("h").agg(F.count("*").alias("bodies")).where("bodies > 1").select("h")
    spread_mixed = least.join(several, "h").select("h", "least.key", "least.place")

    copies = met.where("NOT first").select("key", "place").unionByName(spread_copies)
    begin, count = F.shiftright("place", 14), F.col("place").bitwiseAND(F.lit(127))
    copied = copies.select("key", begin.alias("start"), (begin + count + (length - 1)).alias("stop"))

    mixed = met.where("first AND mixed AND salt < 0").select("h", "key", "place").unionByName(spread_mixed)
    wanted = mixed.groupBy("key").agg(F.collect_list(F.struct("h", "place")).alias("wanted"))
    width = task_count(spark)
    texts = rows.repartition(width, "key").join(wanted, "key")

    def cut(cells: list) -> list[tuple]:
        out = []
        for cell in cells:
            data = cell["text"].encode("utf-8", "surrogatepass")
            made = []
            for w in cell["wanted"]:
                start, many = w["place"] >> 14, w["place"] & 127
                made.append({"h": w["h"], "place": w["place"], "anchor": w["place"] >> 7 & 127, "body": data[start : start + many + length - 1]})
            out.append((made,))
        return out

    bodies = map_text(texts.select("key", F.struct("text", "wanted").alias("cell")), "cell", "s array<struct<h:long,place:long,anchor:int,body:binary>>", cut)
    each = bodies.select("key", F.explode_outer("s").alias("s")).select("key", "s.*").where("h IS NOT NULL").withColumn("size", F.length("body"))
    sorted_out = _sorted_shards(each.repartition(width, "h").sortWithinPartitions("h", "key", "place"), length)
    span = F.struct(F.col("start").alias("start"), F.col("stop").alias("stop"))
    return copied.unionByName(sorted_out).groupBy("key").agg(F.sort_array(F.collect_set(span)).alias("spans"))


def cut_spans(text: str | None, spans: list | None) -> tuple[bytes, int, int, int]:
    """What is left of a text, its bytes, removed bytes and maximal removed runs."""
    data = (text or "").encode("utf-8", "surrogatepass")
    kept, upto, removed, runs = [], 0, 0, 0
    for s in spans or ():
        if s["start"] > upto or not runs:
            kept.append(data[upto : s["start"]])
            runs += 1
            removed += s["stop"] - s["start"]
        else:
            removed += max(0, s["stop"] - upto)
        upto = max(upto, s["stop"])
    kept.append(data[upto:])
    return b"".join(kept), len(data), removed, runs


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of the bytes that are left."""
    plain = plain_ids(docs)
    rows = keyed_rows(docs, plain)
    both = rows.repartition(task_count(docs.sparkSession), "key").join(repeated_spans(docs, length, plain), "key", "left")

    def run(cells: list) -> list[tuple]:
        out = []
        for cell in cells:
            kept, size, removed, runs = cut_spans(cell["text"], cell["spans"])
            out.append((size, removed, runs, hashlib.sha256(kept).hexdigest()))
        return out

    cells = both.select(F.col("key" if plain else "key.doc_id").alias("doc_id"), F.struct("text", "spans").alias("cell"))
    return map_text(cells, "cell", "n_bytes long, n_removed long, n_spans long, kept_sha256 string", run)
