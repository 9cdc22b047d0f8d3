"""Approximate nearest neighbours by an inverted file of coarse centroids and sign codes.

Centroids are fitted on a bounded sample (``SAMPLE_ROWS`` vectors by the hash of their id); every vector is then assigned to the list of its nearest
centroid and stored by list with its access columns and a code: on which side of ``BITS`` random planes it lies. A search goes through the lists of a question from the nearest on, until
``SCAN`` times its pool of ``max(4 k, 100)`` vectors that the user may see were seen: a round probes some lists for all open questions in one scan, and only questions short of
that go on, to twice as many lists. What is seen is compared by code (exclusive-or and bit counts); the pool of every question, those of the nearest codes, is then compared in full.
Invisible vectors are compared in neither way. Each task hands on a pool per question at most.

A list may hold any share of all vectors: the table is dealt by ranges of (list, doc_id), and tasks work on what they read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.operators.access import first_rows, is_restricted
from corpuscope.operators.bm25 import ACCESS_COLUMNS
from corpuscope.operators.dense import MAX_BROADCAST_QUERIES, SCORE_DIGITS, _allowed, _unit
from corpuscope.session import cut_lineage, only_ids, ship_package, task_count

SAMPLE_ROWS, MAX_LISTS, ITERATIONS = 50_000, 2_048, 12
POOL_FACTOR, POOL_LEAST, SCAN = 4, 100, 8
BITS = 256


@dataclass(frozen=True)
class InvertedFile:
    """``vectors``: list, doc_id, embedding, code and the access columns; ``centroids``: unit rows, one per list; ``sizes``: vectors per list; ``planes``: those of the codes."""

    vectors: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    planes: np.ndarray


@dataclass(frozen=True)
class Found:
    """Hits (query_id, doc_id, score, rank), the pairs compared by code and in full for them, and the rounds it took."""

    hits: DataFrame
    coded: int
    compared: int
    rounds: int


def codes(unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The sides of the planes as words of 64 bits, a row each."""
    return np.packbits(unit @ planes.T >= 0, axis=1).view(">u8").astype(np.uint64)


def fit_centroids(sample: np.ndarray, lists: int, iterations: int = ITERATIONS, seed: int = 7) -> np.ndarray:
    """Spherical k-means over unit vectors; an empty list takes the vector that fits its own centroid worst."""
    lists = min(lists, len(sample))
    rng = np.random.default_rng(seed)
    # spread starts: each next one is drawn among the vectors far from all before
    chosen = [int(rng.integers(len(sample)))]
    closest = sample @ sample[chosen[0]]
    for _ in range(lists - 1):
        weight = np.clip(1 - closest, 0, None) ** 2
        total = weight.sum()
        at = int(rng.choice(len(sample), p=weight / total)) if total > 0 else int(rng.integers(len(sample)))
        chosen.append(at)
        closest = np.maximum(closest, sample @ sample[at])
    centroids = sample[chosen].copy()
    for _ in range(iterations):
        scores = sample @ centroids.T
        own = scores.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        if len(empty):
            sums[empty] = sample[np.argsort(scores[np.arange(len(own)), own])[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


def write_inverted(vectors: DataFrame, path: str, lists: int | None = None, sample_rows: int = SAMPLE_ROWS) -> None:
    """Write the inverted file of ``vectors`` (doc_id, embedding and, for searches under permissions, the access columns) below ``path``.

    ``lists`` is the root of the number of vectors unless given, ``MAX_LISTS`` at most.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    kept = ["doc_id", "embedding", *(c for c in ACCESS_COLUMNS if c in vectors.columns)]
    usable = vectors.select(*kept).where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    if lists is None:
        lists = max(1, min(MAX_LISTS, round(usable.count() ** 0.5)))
    sample = usable.select("embedding", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(sample_rows).toPandas()
    centroids = fit_centroids(_unit(sample["embedding"]), lists) if len(sample) else np.zeros((1, 1))
    planes = np.random.default_rng(11).normal(size=(BITS, centroids.shape[1]))
    kinds = dict(usable.dtypes)

    def assign(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            if len(block):
                unit = _unit(block["embedding"])
                yield block.assign(list=(unit @ centroids.T).argmax(axis=1).astype(np.int32), code=[c.tobytes() for c in codes(unit, planes)])

    placed = usable.mapInPandas(assign, ", ".join([*(f"{c} {kinds[c]}" for c in kept), "list int", "code binary"]))
    # a range of (list, doc_id) per task: a large list is spread over several
    (placed.repartitionByRange(task_count(spark), "list", "doc_id").sortWithinPartitions("list", "doc_id").write.mode("overwrite").parquet(f"{path}/vectors"))
    stored = spark.read.parquet(f"{path}/vectors")
    sizes = {r["list"]: r["n"] for r in stored.groupBy("list").agg(F.count("*").alias("n")).collect()}
    rows = [(i, c.tolist(), sizes.get(i, 0)) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "list int, centroid array<double>, size bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(planes)], "nth int, plane array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/planes")


def open_inverted(spark: SparkSession, path: str) -> InvertedFile | None:
    """The inverted file below ``path``, None where there is none."""
    try:
        lists = spark.read.parquet(f"{path}/lists").orderBy("list").toPandas()
        planes = spark.read.parquet(f"{path}/planes").orderBy("nth").toPandas()
        vectors = spark.read.parquet(f"{path}/vectors")
    except AnalysisException:
        return None
    return InvertedFile(vectors, np.stack(lists["centroid"].to_numpy()), lists["size"].to_numpy(), np.stack(planes["plane"].to_numpy()))


def search(queries: DataFrame, index: InvertedFile, k: int, *, pool: int | None = None, open_access: bool = False) -> Found:
    """The best ``k`` visible vectors among the ``pool`` candidates of every question (all that its user may see where there are fewer).

    ``queries``: query_id, embedding, user_id, user_tags (the last two not with ``open_access``). More than ``MAX_BROADCAST_QUERIES`` are searched in groups.
    """
    restricted = is_restricted(queries, open_access)
    spark = index.vectors.sparkSession
    ship_package(spark)
    queries = queries.select("query_id", "embedding", *(["user_id", "user_tags"] if restricted else [])).where("embedding IS NOT NULL")
    groups = max(1, -(-queries.count() // MAX_BROADCAST_QUERIES))
    parts = []
    for group in range(groups):
        some = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == group) if groups > 1 else queries
        parts.append(_search_group(some, index, pool or max(POOL_FACTOR * k, POOL_LEAST)))
    hits = parts[0].hits
    for part in parts[1:]:
        hits = hits.unionByName(part.hits)
    return Found(first_rows(hits, ["query_id"], [F.desc("score"), F.asc("doc_id")], k, "rank"), sum(p.coded for p in parts), sum(p.compared for p in parts), max(p.rounds for p in parts))


def _search_group(queries: DataFrame, index: InvertedFile, pool: int) -> Found:
    """All compared pairs of one group of questions, with their scores."""
    asked = queries.toPandas()
    kinds = dict(queries.dtypes)
    names = f"query_id {kinds['query_id']}, doc_id {dict(index.vectors.dtypes)['doc_id']}"
    if asked.empty:
        return Found(queries.sparkSession.createDataFrame([], f"{names}, score double"), 0, 0, 0)
    unit = _unit(asked["embedding"])
    order = np.argsort(-(unit @ index.centroids.T), axis=1, kind="stable")
    seen, open_, begin, width = np.zeros(len(asked), np.int64), np.arange(len(asked)), 0, 0
    found, rounds = None, 0
    # as many lists at first as hold enough, if all could be seen
    reach = np.cumsum(index.sizes[order], axis=1)
    while len(open_) and begin < len(index.sizes):
        width = 2 * width if rounds else max(1, int(np.median((reach < SCAN * pool).sum(axis=1))) + 1)
        probes = np.zeros((len(asked), len(index.sizes)), bool)
        near = order[open_, begin : begin + width]
        probes[np.repeat(open_, near.shape[1]), near.ravel()] = True
        part = cut_lineage(_probe(asked, unit, probes, index, pool, f"{names}, apart int, visible bigint"))
        counts = {r["query_id"]: r["n"] for r in part.where("doc_id IS NULL").groupBy("query_id").agg(F.sum("visible").alias("n")).collect()}
        seen += np.array([counts.get(q, 0) for q in asked["query_id"].tolist()], np.int64)
        part = part.where("doc_id IS NOT NULL").drop("visible")
        found = part if found is None else found.unionByName(part)
        begin, rounds = begin + width, rounds + 1
        open_ = open_[seen[open_] < SCAN * pool]
    chosen = cut_lineage(first_rows(found, ["query_id"], [F.asc("apart"), F.asc("doc_id")], pool).drop("apart"))
    return Found(_scored(chosen, asked, unit, index, names), int(seen.sum()), chosen.count(), rounds)


def _scored(chosen: DataFrame, asked: pd.DataFrame, unit: np.ndarray, index: InvertedFile, names: str) -> DataFrame:
    """Full comparison of the chosen pairs; only their vectors move."""
    spark = chosen.sparkSession
    place = {q: i for i, q in enumerate(asked["query_id"].tolist())}
    shared = spark.sparkContext.broadcast((place, unit))

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, directions = shared.value
        for block in blocks:
            if len(block):
                mine = directions[[where[q] for q in block["query_id"].tolist()]]
                scores = np.round((1.0 + (mine * _unit(block["embedding"])).sum(axis=1)) / 2.0, SCORE_DIGITS)
                yield pd.DataFrame({"query_id": block["query_id"], "doc_id": block["doc_id"], "score": scores})

    vectors = only_ids(index.vectors.select("doc_id", "embedding"), chosen, "doc_id")
    return chosen.join(vectors, "doc_id").select("query_id", "doc_id", "embedding").mapInPandas(run, f"{names}, score double")


def _probe(asked: pd.DataFrame, unit: np.ndarray, probes: np.ndarray, index: InvertedFile, pool: int, schema: str) -> DataFrame:
    """One scan of the probed lists: per task at most ``pool`` rows per question, of the nearest codes, and a row without a document that counts what was visible."""
    wanted = [int(x) for x in np.flatnonzero(probes.any(axis=0))]
    kept = ["list", "doc_id", "code", *(ACCESS_COLUMNS if "user_id" in asked.columns else ())]
    shared = index.vectors.sparkSession.sparkContext.broadcast((asked.drop(columns="embedding"), codes(unit, index.planes), probes))

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, sides, open_lists = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        visible = np.zeros(len(who), np.int64)
        for block in blocks:
            lists = block["list"].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(lists)) + 1, [len(lists)]]) if len(lists) else np.zeros(1, np.int64)
            for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                rows, some = np.flatnonzero(open_lists[:, lists[begin]]), block.iloc[begin:end]
                allowed = _allowed(who.iloc[rows], some) if "user_id" in who.columns and len(rows) else np.ones((len(rows), len(some)), bool)
                near = allowed.any(axis=0)
                if not near.any():
                    continue
                own = np.frombuffer(b"".join(some["code"][near]), np.uint64).reshape(int(near.sum()), -1)
                apart = np.bitwise_count(sides[rows][:, None, :] ^ own[None, :, :]).sum(axis=2, dtype=np.int32)
                ids, allowed = some["doc_id"].to_numpy()[near], allowed[:, near]
                visible[rows] += allowed.sum(axis=1)
                for at in np.flatnonzero(allowed.any(axis=1)).tolist():
                    row, mine = int(rows[at]), (ids[allowed[at]], apart[at, allowed[at]])
                    if row in best:
                        mine = tuple(np.concatenate(x) for x in zip(best[row], mine, strict=True))
                    top = np.lexsort((mine[0], mine[1]))[:pool]
                    best[row] = tuple(x[top] for x in mine)
        names = who["query_id"].to_numpy()
        if best:
            which = np.concatenate([np.full(len(v[0]), q) for q, v in best.items()])
            yield pd.DataFrame({"query_id": names[which], "doc_id": np.concatenate([v[0] for v in best.values()]), "apart": np.concatenate([v[1] for v in best.values()]), "visible": 0})
        counted = np.flatnonzero(visible)
        if len(counted):
            yield pd.DataFrame({"query_id": names[counted], "doc_id": pd.array([None] * len(counted), dtype="Int64"), "apart": 0, "visible": visible[counted]})

    return index.vectors.where(F.col("list").isin(wanted)).select(*kept).mapInPandas(run, schema)
