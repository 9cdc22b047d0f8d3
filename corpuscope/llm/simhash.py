"""SimHash near-duplicate detection with tiled exact comparison.

A text is lower-cased (A-Z), cut into words and shingles of consecutive words; a fingerprint bit is set when it is set in over half
of the shingles' 64-bit hashes. Equal fingerprints meet first. Distinct fingerprints are cut into tiles by the population counts of
their two halves; a pair of tiles is compared only when the counts differ by no more than the radius, all against all with numpy exclusive-or
and bit counts. A tile pair hands on a spanning forest of its links, never the pairs of a group, a partition one of its tile pairs, and components are then found
by one task or, from very many edges, by alternating large-star and small-star rounds over checkpointed edges.

A fingerprint may be wider than 64 bits. The pipeline links texts whose sets of five-word shingles have a similarity (Jaccard) of
``SIMILAR`` or more: texts with equal sets stand for one. The 256-bit fingerprints of all sets are compared in tiles as above, the tiles now cut by the sizes of the sets, so that all pairs are
compared whose sizes allow 0.8. A bit of two sets at 0.8 differs with odds of 0.1611 at worst (twelve shingles; 0.1875 for a set of four), so ``CANDIDATE_RADIUS`` and, over the first half, ``HALF_RADIUS`` (``FOUR_RADIUS``)
miss a pair with odds under 1 in 100,000,000; sets of under four have none but equal ones. Links of fingerprints are candidates: their components are compared by the shingles themselves; one of up to ``BLOCK_SHINGLES`` is settled
in one place, larger ones are cut into blocks that are compared pair by pair, and only the links found so count.

Cases: fewer words than a shingle needs make one shingle of all words; a text of any length is hashed in pieces of 65,536 shingles; a wordless, empty or null text has the fingerprint zero and
links like any other by its fingerprint, and as a shingle set only with other empty sets. Equal texts and repeated rows share a fingerprint. The component is the smallest doc_id reachable; a null
doc_id is smaller than none, so a component has one only if all its ids are null. Empty tables give no rows; columns of other names are left out, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.base import map_text, row_key, salted_join, small_enough
from corpuscope.session import cut_lineage, ship_package, task_count

SHINGLE, RADIUS, SEED = 4, 4, 42
WIDE_SHINGLE, WIDE_WORDS = 5, 4
SIMILAR, CANDIDATE_RADIUS, HALF_RADIUS = 0.8, 80, 50
#: both radii where the smaller set has four shingles
FOUR_RADIUS = 90, 54
#: sets of a tile at most, about; two tiles need some 300 bytes for each
BUCKET = 16_384
#: fingerprints of sets compared at a time: so many of one tile with so many of the other (what fits a core's cache)
SET_ROWS, SET_COLUMNS = 64, 4_096
#: a set in a tile
RECORD = np.dtype([("set", "V16"), ("n", ">i8"), ("fp", ">u8", (WIDE_WORDS,))])
#: shingles of a block of candidates at most, about (a longer text is a block of its own); a pair of blocks needs some 100 bytes for each
BLOCK_SHINGLES = 1 << 20
#: edges up to which one task finds the components; it needs some 200 bytes for each
TASK_EDGES = 1 << 20
#: fingerprints of a tile at most, about; a tile pair needs some ROWS x TILE x 9 bytes
TILE, ROWS = 16_384, 256


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, split at space and tab to return
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[:-1]])[: len(words) - size + 1].tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(begins, (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, len(begins))


def _other(hashes: np.ndarray, nth: int) -> np.ndarray:
    """Further 64 bits of every hash (the finaliser of splitmix64)."""
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * nth) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, size: int = SHINGLE, words: int = 1) -> bytes:
    """``words`` x 64 bits, big-endian."""
    return _fingerprint(shingle_hashes(text, size), words)


def _fingerprint(hashes: np.ndarray, words: int) -> bytes:
    out = np.zeros(words, ">u8")
    for nth in range(words if len(hashes) else 0):
        votes = np.zeros(64, np.int64)
        for part in range(0, len(hashes), 65_536):
            some = hashes[part : part + 65_536]
            some = _other(some, nth) if nth else some
            votes += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[nth] = np.packbits((2 * votes > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0]
    return out.tobytes()


def fingerprints(docs: DataFrame, size: int = SHINGLE, words: int = 1) -> DataFrame:
    """``doc_id``, ``text_hash``, ``fp`` and the population counts of its halves, ``high`` and ``low``, of every row."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), row_key(docs)["text_hash"].alias("text_hash"), docs["text"].cast("string").alias("text"))

    def run(texts: list) -> list[tuple]:
        prints = [fingerprint(t, size, words) for t in texts]
        half = 4 * words
        return [(p, int.from_bytes(p[:half], "big").bit_count(), int.from_bytes(p[half:], "big").bit_count()) for p in prints]

    return map_text(rows, "text", "fp binary, high int, low int", run)


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between two arrays of distinct fingerprints, a row each (or within one, ``a is b``)."""
    both = a if a is b else np.concatenate([a, b])
    shift = 0 if a is b else len(a)
    label = np.arange(len(both))
    for start in range(0, len(a), ROWS):
        apart = np.bitwise_count(a[start : start + ROWS, None, 0] ^ b[None, :, 0])
        for nth in range(1, a.shape[1]):
            apart = apart.astype(np.uint16) + np.bitwise_count(a[start : start + ROWS, None, nth] ^ b[None, :, nth])
        rows, cols = np.nonzero(apart <= radius)
        _union(label, rows + start, cols + shift)
    label = _roots(label)
    linked = np.nonzero(label != np.arange(len(label)))[0]
    return both[linked], both[label[linked]]


def _roots(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def _union(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Hook the larger root of every link under the smaller one until both ends agree; in place."""
    while len(x):
        label[:] = _roots(label)
        rx, ry = label[x], label[y]
        apart = rx != ry
        if not apart.any():
            return
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(label, np.maximum(rx, ry), np.minimum(rx, ry))


def tiles(prints: DataFrame, width: int, tile: int = TILE) -> DataFrame:
    """``h``, ``l`` (population counts of both halves, over ``width``), ``part`` and ``prints``: distinct fingerprints packed into one binary per tile."""
    cells = prints.select(F.floor(F.col("high") / width).cast("int").alias("h"), F.floor(F.col("low") / width).cast("int").alias("l"), F.xxhash64("fp").alias("by"), F.hex("fp").alias("hex"))
    return _packed(cells, tile)


def _packed(cells: DataFrame, tile: int) -> DataFrame:
    """One binary ``prints`` per ``h``, ``l`` and ``part`` of ``cells`` (h, l, by, hex); rows of a cell are dealt to parts by their hash ``by``."""
    sizes = {(r["h"], r["l"]): r["n"] for r in cells.groupBy("h", "l").agg(F.count("*").alias("n")).collect()}  # as many rows as pairs of counts
    parts = {cell: -(-n // tile) for cell, n in sizes.items() if n > tile}
    count = F.lit(1)
    if parts:
        table = F.create_map(*[x for (h, l), n in parts.items() for x in (F.lit(f"{h}:{l}"), F.lit(n))])
        count = F.coalesce(table[F.concat_ws(":", "h", "l")], F.lit(1))
    placed = cells.withColumn("part", F.pmod("by", count).cast("int"))
    return placed.groupBy("h", "l", "part").agg(F.array_join(F.collect_list("hex"), "").alias("hex")).select("h", "l", "part", F.unhex("hex").alias("prints"))


def _met(packed: DataFrame, near: list[tuple[int, int]]) -> DataFrame:
    """``prints1``, ``prints2`` (null: the same) of every pair of tiles whose cells lie ``near`` steps apart."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in near])
    left = packed.withColumn("step", F.explode(steps)).select(
        F.struct("h", "l", "part").alias("one"), (F.col("h") + F.col("step.i")).alias("h"), (F.col("l") + F.col("step.j")).alias("l"))
    names = packed.select(F.struct("h", "l", "part").alias("two"), "h", "l")
    pairs = left.join(names, ["h", "l"]).where((F.col("one.h") != F.col("two.h")) | (F.col("one.l") != F.col("two.l")) | (F.col("one.part") <= F.col("two.part")))
    first = packed.select(F.struct("h", "l", "part").alias("one"), F.col("prints").alias("prints1"))
    second = packed.select(F.struct("h", "l", "part").alias("two"), F.col("prints").alias("prints2"))
    return pairs.join(first, "one").join(second, "two").select("prints1", F.when(F.col("one") != F.col("two"), F.col("prints2")).alias("prints2"))


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, words: int = 1) -> DataFrame:
    """Edges ``u``, ``v`` between distinct fingerprints whose components are those of all links within the radius."""
    width = max(1, radius // 4)
    packed = cut_lineage(tiles(prints, width, tile))
    least = lambda step: max(0, (abs(step) - 1) * width + 1)  # noqa: E731  how far counts in cells so many steps apart differ at least
    far = range(-radius // width - 1, radius // width + 2)
    work = _met(packed, [(i, j) for i in far for j in far if least(i) + least(j) <= radius and (i, j) >= (0, 0)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = lambda packed: np.frombuffer(packed, ">u8").astype(np.uint64).reshape(-1, words)
        for batch in batches:
            for one, two in zip(batch["prints1"], batch["prints2"], strict=True):
                a = unpack(one)
                u, v = forest(a, a if two is None else unpack(two), radius)
                yield pd.DataFrame({"u": [x.tobytes() for x in u.astype(">u8")], "v": [x.tobytes() for x in v.astype(">u8")]})

    return work.repartition(task_count(prints.sparkSession)).mapInPandas(run, "u binary, v binary")


def components(edges: DataFrame, rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """``node`` and ``root`` (the smallest node of the component) of every node with an edge.

    Every partition keeps a spanning forest of its edges. What is left goes to one task, or, beyond ``task_edges``, through alternating large-star and small-star rounds: a round costs
    the driver two jobs and a dozen stages, so that many rounds fill its memory.
    """
    ship_package(edges.sparkSession)
    edges = cut_lineage(edges.where("u <> v").select("u", "v").mapInArrow(_forests, edges.select("u", "v").schema).distinct())
    if edges.count() <= task_edges:
        name = edges.schema["u"].dataType.simpleString()
        return edges.coalesce(1).mapInArrow(_rooted, f"node {name}, root {name}")
    before = None
    for _ in range(rounds):
        # large star: every larger neighbour of a node moves to the smallest of its neighbourhood
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted_join(ways, least, ["u"], F.xxhash64("v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours move to the smallest of them
        large = large.where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = salted_join(large, small_least, ["u"], F.xxhash64("v"))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components are not settled after {rounds} rounds")


def _labelled(batches: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray]:
    """The nodes of the edges ``u``, ``v`` in order, and for each the place of the smallest node that it is linked to."""
    ends = pa.chunked_array([b.column(c) for c in ("u", "v") for b in batches])
    coded = ends.combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    u, v = np.split(place[coded.indices.to_numpy()], 2)
    label = np.arange(len(order))
    _union(label, u, v)
    return coded.dictionary.take(pa.array(order)), _roots(label)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars that link what the edges ``u``, ``v`` link, for up to ``TASK_EDGES`` of them at a time."""
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        nodes, label = _labelled(held)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(linked)), nodes.take(pa.array(label[linked]))], names=["u", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= TASK_EDGES:
            yield stars()
            held = []
    if held:
        yield stars()


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        nodes, label = _labelled(held)
        for start in range(0, len(label), 10_000):
            part = nodes.slice(start, 10_000)
            yield pa.RecordBatch.from_arrays([part, nodes.take(pa.array(label[start : start + 10_000]))], names=["node", "root"])


def grouped(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, words: int = 1, tile: int = TILE) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``text_hash``, ``fp`` and ``root``, a fingerprint that stands for the component."""
    rows = cut_lineage(fingerprints(docs, size, words))  # narrow: the texts are read once
    prints = rows.groupBy("fp").agg(F.first("high").alias("high"), F.first("low").alias("low"))
    found = components(links(prints, radius, tile, words))
    rooted = prints.join(found, prints["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return salted_join(rows, rooted, ["fp"], F.xxhash64("doc_id", "text_hash")).select("doc_id", "text_hash", "fp", "root")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, words: int = 1, tile: int = TILE) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``_key``, ``fingerprint`` (hex digits) and ``component_id``."""
    rows = cut_lineage(grouped(docs, size, radius, words, tile))
    ids = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return salted_join(rows, ids, ["root"], F.xxhash64("doc_id", "text_hash")).select(
        "doc_id", F.struct("doc_id", "text_hash").alias("_key"), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def shingle_sets(docs: DataFrame, size: int = WIDE_SHINGLE, words: int = WIDE_WORDS) -> DataFrame:
    """``doc_id``, ``text_hash`` and, of the set of shingles, its name ``set``, its size ``n`` and ``fp``, of every row."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), row_key(docs)["text_hash"].alias("text_hash"), docs["text"].cast("string").alias("text"))

    def run(texts: list) -> list[tuple]:
        out = []
        for text in texts:
            hashes = np.unique(shingle_hashes(text, size))
            out.append((xxhash.xxh3_128_digest(hashes.tobytes()), len(hashes), _fingerprint(hashes, words)))
        return out

    return map_text(rows, "text", "set binary, n long, fp binary", run)


def set_links(sets: DataFrame, least: float = SIMILAR, tile: int = BUCKET) -> DataFrame:
    """Edges ``u``, ``v`` between names of distinct ``sets`` (``set``, ``n``, ``fp``) whose components are those of all pairs with sizes and fingerprints of similar sets."""
    # sizes that may be similar lie in one class or in neighbouring ones (classes are a little wider than the limit, whatever the rounding)
    size = F.floor(F.log(F.col("n").cast("double")) / F.lit(1.000001 * float(np.log(1 / least)))).cast("int")
    record = F.concat(F.hex("set"), F.lpad(F.hex("n"), 16, "0"), F.hex("fp"))
    packed = cut_lineage(_packed(sets.select(size.alias("h"), F.lit(0).alias("l"), F.xxhash64("set").alias("by"), record.alias("hex")), tile))
    work = _met(packed, [(0, 0), (1, 0)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one, two in zip(batch["prints1"], batch["prints2"], strict=True):
                a = np.frombuffer(one, RECORD)
                u, v = alike(a, a if two is None else np.frombuffer(two, RECORD), least)
                yield pd.DataFrame({"u": [x.tobytes() for x in u], "v": [x.tobytes() for x in v]}, dtype=object)

    return work.repartition(task_count(sets.sparkSession)).mapInPandas(run, "u binary, v binary")


def alike(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """Names at both ends of a spanning forest of the pairs between two tiles of ``RECORD`` (or within one, ``a is b``) whose sizes allow a similarity of ``least`` and whose fingerprints lie within the radius."""
    a, b = (a[np.argsort(a["n"], kind="stable")], None if a is b else b[np.argsort(b["n"], kind="stable")])
    shift, both = (0, a) if b is None else (len(a), np.concatenate([a, b]))
    n, prints = both["n"].astype(np.int64), np.ascontiguousarray(both["fp"].T.astype(np.uint64))
    label, found = np.arange(len(both)), []
    for start in range(0, len(a), SET_ROWS):
        end = min(start + SET_ROWS, len(a))
        half = FOUR_RADIUS[1] if n[start] <= 4 else HALF_RADIUS
        # the sizes that any of these rows may be similar to; within one tile only rows from here on
        low, high = shift + np.searchsorted(n[shift:], [least * n[start] - 1e-9, n[end - 1] / least + 1e-9]).astype(np.int64)
        for left in range(max(low, 0 if shift else start), high, SET_COLUMNS):
            right = min(left + SET_COLUMNS, high)
            apart = np.bitwise_count(prints[0, start:end, None] ^ prints[0, None, left:right])
            apart += np.bitwise_count(prints[1, start:end, None] ^ prints[1, None, left:right])
            rows, cols = np.divmod(np.flatnonzero(apart <= half), right - left)
            rows, cols = rows + start, cols + left
            open_ = (label[rows] != label[cols]) & (rows < cols)
            rows, cols = rows[open_], cols[open_]
            few, many = np.minimum(n[rows], n[cols]), np.maximum(n[rows], n[cols])
            # different sets of one size share all but one shingle each at most
            fits = np.where(few < many, few + 1e-9 >= least * many, few - 1 + 1e-9 >= least * (few + 1))
            rows, cols, few = rows[fits], cols[fits], few[fits]
            near = np.bitwise_count(prints[:, rows] ^ prints[:, cols]).sum(axis=0, dtype=np.int64) <= np.where(few <= 4, FOUR_RADIUS[0], CANDIDATE_RADIUS)
            found.append((rows[near], cols[near]))
            if len(found) > 1_000 or len(found[-1][0]) > 10_000:
                _union(label, *(np.concatenate(side) for side in zip(*found, strict=True)))
                label[:] = _roots(label)
                found = []
    if found:
        _union(label, *(np.concatenate(side) for side in zip(*found, strict=True)))
    label = _roots(label)
    linked = np.flatnonzero(label != np.arange(len(label)))
    return both["set"][linked], both["set"][label[linked]]


def similar(one: list[np.ndarray], two: list[np.ndarray] | None, least: float = SIMILAR) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of distinct sorted sets of ``one`` and ``two`` (or of ``one``) whose similarity is ``least`` or more, as places in both lists together."""
    sets = one if two is None else one + two
    sizes = np.array([len(s) for s in sets], np.int64)
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    ends = np.cumsum(sizes)
    order = np.argsort(number, kind="stable")
    holders = owner[order]  # of the first shingle, of the second, ...
    first = np.concatenate([[0], np.cumsum(np.bincount(number))])
    label, edges = np.arange(len(sets)), []
    for at in range(len(one)):
        begin = at + 1 if two is None else len(one)
        label = _roots(label)
        if (label[begin:] == label[at]).all():
            continue
        shared = np.zeros(len(sets), np.int64)
        for part in range(ends[at] - sizes[at], ends[at], 4_096):
            mine = number[part : min(part + 4_096, ends[at])]
            many = first[mine + 1] - first[mine]
            where = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            shared += np.bincount(holders[where], minlength=len(sets))
        found = np.nonzero(shared[begin:] >= least * (sizes[at] + sizes[begin:] - shared[begin:]))[0] + begin
        found = found[label[found] != label[at]]
        _, once = np.unique(label[found], return_index=True)
        edges += [(at, int(x)) for x in found[once]]
        _union(label, np.full(len(once), at), found[once])
    return edges


def similar_sets(docs: DataFrame, sets: DataFrame, least: float = SIMILAR, block: int = BLOCK_SHINGLES, tile: int = BUCKET, size: int = WIDE_SHINGLE) -> DataFrame:
    """``node`` and ``root``: the group of every set but its root whose similarity to some other is ``least`` or more; ``sets`` are the distinct ``shingle_sets`` of ``docs`` with a ``_key`` each."""
    many = sets.where("n > 3")
    found = components(set_links(many, least, tile=tile))
    placed = cut_lineage(many.select("_key", "set", "n").join(found.select(F.col("node").alias("set"), F.col("root").alias("part")), "set"))
    parts = placed.groupBy("part").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    members = salted_join(placed, parts, ["part"], F.xxhash64("set"))
    members = cut_lineage(members.withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")).drop("n"))
    texts = docs.select(row_key(docs).alias("_key"), docs["text"].cast("string").alias("text"))
    held = texts.join(F.broadcast(members) if small_enough(members, 50_000) else members, "_key").dropDuplicates(["set"])
    hashed = map_text(held.select("set", "part", "blocks", "block", "text"), "text", "shingles binary", lambda texts: [(np.unique(shingle_hashes(t, size)).tobytes(),) for t in texts])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = hashed.select("set", "part", "blocks", "block", "shingles", other).select(
        "part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "blocks", "set", "shingles")
    spread = pairs.repartition(task_count(docs.sparkSession), "part", "i", "j").sortWithinPartitions("part", "i", "j")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, []
        for batch in batches:
            for part, i, j, own, blocks, name, packed in zip(*(batch[c] for c in ("part", "i", "j", "block", "blocks", "set", "shingles")), strict=True):
                if (part, i, j, blocks) != last:
                    yield from compared(last, held)
                    last, held = (part, i, j, blocks), []
                held.append((own, name, np.frombuffer(packed, np.uint64)))
        yield from compared(last, held)

    def compared(group: tuple | None, held: list) -> Iterator[pd.DataFrame]:
        if len(held) < 2:
            return
        one = [h for h in held if h[0] == group[1]]
        two = [h for h in held if h[0] != group[1]]
        if group[1] != group[2] and not (one and two):
            return
        edges = similar([h[2] for h in one], [h[2] for h in two] if two else None, least)
        names = [h[1] for h in one + two]
        if group[3] == 1:  # all of the component is here: stars are final
            label = np.arange(len(names))
            _union(label, *(np.array([e[k] for e in edges], np.int64) for k in (0, 1)))
            edges = [(at, int(root)) for at, root in enumerate(_roots(label)) if at != root]
        yield pd.DataFrame({"u": [names[a] for a, _ in edges], "v": [names[b] for _, b in edges], "final": group[3] == 1}, dtype=object)

    links = cut_lineage(spread.mapInPandas(run, "u binary, v binary, final boolean"))
    settled = links.where("final").select(F.col("u").alias("node"), F.col("v").alias("root"))
    open_links = links.where("NOT final").select("u", "v")
    return settled if open_links.isEmpty() else settled.unionByName(components(open_links))


def survivors(docs: DataFrame, least: float = SIMILAR, block: int = BLOCK_SHINGLES, tile: int = BUCKET) -> DataFrame:
    """``_key`` of the document that stays of every group of texts linked by a similarity of ``least`` or more: that of smallest doc_id, then text hash."""
    key = F.struct("doc_id", "text_hash")
    firsts = shingle_sets(docs).groupBy("set").agg(F.min(key).alias("_key"), *(F.first(c).alias(c) for c in ("n", "fp")))
    sets = cut_lineage(firsts)  # narrow: read several times
    found = similar_sets(docs, sets, least, block=block, tile=tile)
    rooted = sets.select("_key", "set").join(found, sets["set"] == found["node"], "left").select("_key", F.coalesce("root", "set").alias("root"))
    return rooted.groupBy("root").agg(F.min("_key").alias("_key")).select("_key")
