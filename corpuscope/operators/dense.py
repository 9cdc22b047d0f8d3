"""Exact nearest neighbours under permissions.

The search never forms query-document pairs as rows: each task multiplies blocks of its own documents with a block
of queries and keeps the best k per query, so at most k rows per query leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.operators.access import first_rows, is_restricted, visible

MAX_BROADCAST_QUERIES = 8192
SCORE_DIGITS = 9
#: scores (questions x documents) that a task holds at a time
SCORE_CELLS = 4_000_000
_OUT = "query_id bigint, doc_id bigint, score double"


def _unit(rows: pd.Series) -> np.ndarray:
    matrix = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0.0, 1.0, norms)


def _allowed(queries: pd.DataFrame, block: pd.DataFrame) -> np.ndarray:
    """queries x documents visibility of one block."""
    tags, codes = np.unique(block["org_tag"].fillna("").to_numpy(dtype=str), return_inverse=True)
    holds = np.array([np.isin(tags, list(t)) for t in queries["user_tags"]]).reshape(len(queries), len(tags))
    holds[:, tags == ""] = False
    owner = queries["user_id"].to_numpy()[:, None] == block["owner_id"].to_numpy()[None, :]
    return holds[:, codes] | owner | block["is_public"].fillna(False).to_numpy(dtype=bool)[None, :]


class _Best:
    """The best ``k`` documents of every question so far; at most ``SCORE_CELLS`` scores are held at a time."""

    def __init__(self, queries: pd.DataFrame, unit_queries: np.ndarray, k: int):
        self.queries, self.unit, self.k = queries, unit_queries, k
        self.scores, self.ids = np.full((len(queries), 0), -np.inf), np.zeros((len(queries), 0), np.int64)

    def add(self, block: pd.DataFrame) -> None:
        step = max(1, SCORE_CELLS // max(1, len(self.queries)))
        for start in range(0, len(block), step):
            part = block.iloc[start : start + step]
            scores = np.round((1.0 + self.unit @ _unit(part["embedding"]).T) / 2.0, SCORE_DIGITS)
            if "user_tags" in self.queries.columns:
                scores[~_allowed(self.queries, part)] = -np.inf
            ids = np.broadcast_to(part["doc_id"].to_numpy(), scores.shape)
            scores, ids = np.hstack([self.scores, scores]), np.hstack([self.ids, ids])
            order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
            self.scores, self.ids = np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)

    def rows(self) -> pd.DataFrame:
        q, d = np.nonzero(self.scores > -np.inf)
        return pd.DataFrame({"query_id": self.queries["query_id"].to_numpy()[q], "doc_id": self.ids[q, d], "score": self.scores[q, d]})


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, *, query_blocks: int | None = None,
               document_blocks: int | None = None, open_access: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): best ``k`` visible documents by (1 + cosine) / 2.

    ``queries``: query_id, embedding, user_id, user_tags. ``vectors``: doc_id, embedding, owner_id, org_tag, is_public.
    With ``open_access`` every vector is visible and only ids and embeddings are needed. Up to MAX_BROADCAST_QUERIES queries travel to the scan of the documents,
    which then needs no shuffle. A larger query table is cut into blocks that meet the document blocks in a grid.
    """
    restricted = is_restricted(queries, open_access)
    q_cols = ["query_id", "embedding", *(["user_id", "user_tags"] if restricted else [])]
    v_cols = ["doc_id", "embedding", *(["owner_id", "org_tag", "is_public"] if restricted else [])]
    queries, vectors = queries.select(*q_cols), vectors.select(*v_cols)
    if query_blocks is None:
        head = queries.limit(MAX_BROADCAST_QUERIES + 1).toPandas()
        if len(head) <= MAX_BROADCAST_QUERIES:
            local = _scan_search(head, vectors, k)
            return first_rows(local, ["query_id"], [F.desc("score"), F.asc("doc_id")], k, "rank")
        query_blocks = -(-queries.count() // MAX_BROADCAST_QUERIES)
    if document_blocks is None:
        document_blocks = max(1, -(-vectors.count() // 65_536))
    local = _grid_search(queries, vectors, k, query_blocks, document_blocks)
    return first_rows(local, ["query_id"], [F.desc("score"), F.asc("doc_id")], k, "rank")


def _scan_search(head: pd.DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    if head.empty:
        return vectors.sparkSession.createDataFrame([], _OUT)
    shared = vectors.sparkSession.sparkContext.broadcast((head, _unit(head["embedding"])))

    def search(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, unit_queries = shared.value
        best = _Best(asked, unit_queries, k)
        for block in blocks:
            best.add(block)
        yield best.rows()

    return vectors.mapInPandas(search, _OUT)


def _grid_search(queries: DataFrame, vectors: DataFrame, k: int, query_blocks: int, document_blocks: int) -> DataFrame:
    """Every (query block, document block) cell is one bounded group; block sizes follow from the counted rows."""
    # both sides may stem from one table, so the query columns get names of their own
    named = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    q = (named.withColumn("qb", F.pmod(F.xxhash64("q_query_id"), F.lit(query_blocks)))
         .withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(document_blocks - 1)))))
    d = (vectors.select(*[F.col(c).alias(f"d_{c}") for c in vectors.columns])
         .withColumn("db", F.pmod(F.xxhash64("d_doc_id"), F.lit(document_blocks)).cast("int"))
         .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumn("qb", F.col("qb").cast("bigint")))

    def cell(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or block.empty:
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        asked, block = asked.rename(columns=lambda c: c.removeprefix("q_")), block.rename(columns=lambda c: c.removeprefix("d_"))
        best = _Best(asked, _unit(asked["embedding"]), k)
        best.add(block)
        return best.rows()

    return q.groupBy("qb", "db").cogroup(d.groupBy("qb", "db")).applyInPandas(cell, _OUT)
