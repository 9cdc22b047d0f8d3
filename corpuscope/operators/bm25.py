"""BM25 ranking of many queries over a document table, with permissions applied before the top-k.

Plan: tokens of a document are filtered to the query vocabulary inside the scan stage (the vocabulary is broadcast
when its counted size allows it), shuffled once by document, counted, joined with the query terms and summed per
(query, document) without another shuffle, because the rows are already placed by document. The top-k limits rows
per query before its own shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.text import tokens
from corpuscope.operators.access import first_rows, is_restricted, visible
from corpuscope.session import join_on_hot_keys, spread, task_count

K1, B, MIN_SCORE = 1.2, 0.75, 0.3
ACCESS_COLUMNS = ("owner_id", "org_tag", "is_public")
SCORE_DIGITS = 9
#: term rows times (1 + tags of the user) up to which the question side is broadcast
BROADCAST_CELLS = 1_000_000


def corpus_stats(docs: DataFrame) -> tuple[Column, Column]:
    """Number of documents and their mean token count, as scalar subqueries."""
    stats = docs.select(F.size(tokens("text")).alias("dl"))
    return stats.select(F.count("*")).scalar(), stats.select(F.avg("dl")).scalar()


def query_terms(queries: DataFrame) -> DataFrame:
    """(query columns, term, n_terms): each distinct term of a query once."""
    terms = F.array_distinct(tokens("text"))
    return (queries.withColumn("_terms", terms).withColumn("n_terms", F.size("_terms"))
            .withColumn("term", F.explode_outer("_terms")).drop("_terms", "text"))


def postings(docs: DataFrame, vocabulary: DataFrame, small_vocabulary: bool) -> DataFrame:
    """(doc_id, access columns, dl, term, tf) for the terms of ``vocabulary``, placed by document."""
    kept = [c for c in ("doc_id", *ACCESS_COLUMNS) if c in docs.columns]
    exploded = (docs.select(*kept, tokens("text").alias("_t")).withColumn("dl", F.size("_t"))
                .withColumn("term", F.explode_outer("_t")).drop("_t"))
    wanted = F.broadcast(vocabulary) if small_vocabulary else vocabulary
    return (exploded.join(wanted, "term", "left_semi").repartition(task_count(docs.sparkSession), "doc_id")
            .groupBy(*kept, "dl", "term").agg(F.count("*").alias("tf")))


def _terms_fit(queries: DataFrame, restricted: bool) -> bool:
    """Whether the question terms, each with its user's tags, are few enough to be broadcast. One combinable sum."""
    width = F.lit(1) + F.size("user_tags") if restricted else F.lit(1)
    cells = queries.agg(F.sum(F.size(tokens("text")) * width).alias("n")).first()["n"]
    return (cells or 0) <= BROADCAST_CELLS


def bm25_scores(queries: DataFrame, docs: DataFrame, *, k1: float = K1, b: float = B, open_access: bool = False) -> DataFrame:
    """(query_id, doc_id, score, matched, n_terms) of every visible document that shares a term with the query.

    ``queries``: query_id, text, user_id and user_tags. ``docs``: doc_id, text, owner_id, org_tag, is_public. With
    ``open_access`` every document is visible and only ids and texts are needed. Document frequencies are taken over the whole table.
    """
    restricted = is_restricted(queries, open_access)
    asked = query_terms(queries.select("query_id", "text", *(["user_id", "user_tags"] if restricted else [])))
    docs = spread(docs.select(*[c for c in ("doc_id", "text", *ACCESS_COLUMNS) if c in docs.columns]), "doc_id")
    vocabulary = queries.select(F.explode_outer(tokens("text")).alias("term"))
    small = _terms_fit(queries, restricted)
    found = postings(docs, vocabulary.distinct(), small)
    n_docs, mean_length = corpus_stats(docs)
    frequency = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(frequency.select("term", idf.alias("idf")), "term")
    pairs = join_on_hot_keys(found, weighted, ["term"], salt_by=["doc_id"], small_fits=small)
    if restricted:
        pairs = pairs.where(visible())
    part = F.col("idf") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / mean_length))
    return pairs.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(part), SCORE_DIGITS).alias("score"), F.count("*").alias("matched"), F.max("n_terms").alias("n_terms"))


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int, *, min_score: float = MIN_SCORE, open_access: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank) of the best ``k`` documents per query with at least ``min_score``."""
    scored = bm25_scores(queries, docs, open_access=open_access).where(F.col("score") >= min_score)
    return first_rows(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], k, "rank").drop("matched", "n_terms")


def bm25_all_terms_rescore(queries: DataFrame, docs: DataFrame, k: int, window: int, *,
                           first_weight: float = 0.2, all_terms_weight: float = 1.0, open_access: bool = False) -> DataFrame:
    """Rescore the recall window: first pass times 0.2, plus the full score where all terms match."""
    recall = first_rows(bm25_scores(queries, docs, open_access=open_access), ["query_id"], [F.desc("score"), F.asc("doc_id")], window)
    bonus = F.when(F.col("matched") == F.col("n_terms"), F.col("score")).otherwise(0.0)
    final = F.round(first_weight * F.col("score") + all_terms_weight * bonus, SCORE_DIGITS)
    rescored = recall.select("query_id", "doc_id", final.alias("score"))
    return first_rows(rescored, ["query_id"], [F.desc("score"), F.asc("doc_id")], k, "rank")
