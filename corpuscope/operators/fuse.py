"""Fusion of ranked lists, hybrid search, reranking and widening to parent passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.text import rerank_terms
from corpuscope.operators.access import first_rows
from corpuscope.operators.bm25 import bm25_scores
from corpuscope.operators.dense import dense_topk
from corpuscope.operators.postings import Postings, lexical_topk
from corpuscope.session import cut_lineage, only_ids

RANK_CONSTANT = 60
SCORE_DIGITS = 12
PER_CHANNEL, FUSION_LIMIT, FINAL_LIMIT, RERANK_LIMIT, MAX_VARIANTS = 30, 40, 8, 40, 4
LEXICAL_WEIGHT, RRF_WEIGHT, RRF_SCALE = 0.7, 0.3, 30.0


def ranked(df: DataFrame, channel: str, query_type: str = "ORIGINAL") -> DataFrame:
    """Tag one channel's rows so that lists can be united."""
    return df.select("query_id", "doc_id", "rank", "score", F.lit(channel).alias("channel"), F.lit(query_type).alias("query_type"))


def mode_label(channels: Column) -> Column:
    both = F.array_contains(channels, "BM25") & F.array_contains(channels, "VECTOR")
    return F.when(both, "HYBRID_RRF").when(F.array_contains(channels, "VECTOR"), "VECTOR_ONLY").otherwise("BM25_ONLY")


def rrf(lists: DataFrame, limit: int, *, rank_constant: int = RANK_CONSTANT) -> DataFrame:
    """Reciprocal rank fusion of any number of lists (query_id, doc_id, rank, channel).

    Returns (query_id, doc_id, rrf_score, n_hits, retrieval_mode, rank). Ties go to the smaller document id.
    """
    part = 1.0 / (F.lit(rank_constant) + F.col("rank"))
    fused = lists.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(part), SCORE_DIGITS).alias("rrf_score"), F.count("*").alias("n_hits"),
        mode_label(F.collect_set("channel")).alias("retrieval_mode"))
    return first_rows(fused, ["query_id"], [F.desc("rrf_score"), F.asc_nulls_last("doc_id")], limit, "rank")


def provenance(lists: DataFrame, fused: DataFrame, *, rank_constant: int = RANK_CONSTANT) -> DataFrame:
    """Add ``hits``: the list entries behind every fused row, with their contribution."""
    part = F.round(1.0 / (F.lit(rank_constant) + F.col("rank")), SCORE_DIGITS).alias("rrf_contribution")
    entries = lists.join(fused.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    hits = entries.groupBy("query_id", "doc_id").agg(
        F.sort_array(F.collect_list(F.struct("channel", "query_type", "rank", "score", part))).alias("hits"))
    return fused.join(hits, ["query_id", "doc_id"])


def attach_names(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``file_name``; the smallest name stands where one key has several, unknown keys get null."""
    hits = cut_lineage(hits)  # read for its ids first, so that names of other files do not move
    names = only_ids(files.select("doc_id", "file_name"), hits, "doc_id").groupBy("doc_id").agg(F.min("file_name").alias("file_name"))
    return hits.join(names, "doc_id", "left")


def hybrid_search(queries: DataFrame, docs: DataFrame | Postings, vectors: DataFrame, k: int, *, recall_factor: int = 4) -> DataFrame:
    """Permissioned BM25 and vector recall of depth 4k, fused; a query without vector hits keeps its BM25 order.

    ``queries`` needs query_id, text, embedding (null allowed), user_id, user_tags. ``docs`` are documents or their stored postings.
    """
    depth = recall_factor * k
    lexical = ranked(lexical_topk(queries.drop("embedding"), docs, depth), "BM25")
    dense = ranked(dense_topk(queries.where("embedding IS NOT NULL").drop("text"), vectors, depth), "VECTOR")
    return rrf(lexical.unionByName(dense), k)


def legacy_hybrid(queries: DataFrame, docs: DataFrame, vectors: DataFrame, k: int, *, recall_factor: int = 30) -> DataFrame:
    """One-shot search: vector recall of depth 30k must match the text too, rescored by all-terms BM25, top-k."""
    depth = recall_factor * k
    plain = queries.select("query_id", "text")
    near = dense_topk(queries.select("query_id", "embedding"), vectors.select("doc_id", "embedding"), depth, open_access=True)
    lexical = bm25_scores(plain, docs.select("doc_id", "text"), open_access=True)
    joined = near.select("query_id", "doc_id", F.col("score").alias("vector_score")).join(lexical, ["query_id", "doc_id"], "full_outer")
    first = F.coalesce("vector_score", F.lit(0.0)) + F.coalesce("score", F.lit(0.0))
    window = first_rows(joined.withColumn("first", F.round(first, 9)), ["query_id"], [F.desc("first"), F.asc("doc_id")], depth)
    bonus = F.when(F.col("matched") == F.col("n_terms"), F.col("score")).otherwise(0.0)
    final = window.select("query_id", "doc_id", F.round(0.2 * F.col("first") + bonus, 9).alias("score"))
    return first_rows(final, ["query_id"], [F.desc("score"), F.asc("doc_id")], k, "rank")


def recall_round(variants: DataFrame, docs: DataFrame | Postings, vectors: DataFrame | None, k: int) -> DataFrame:
    """Ranked lists of all variants of all queries: one BM25 job and one vector job, max(k, 30) rows per list.

    ``variants``: query_id, variant_no, variant_type, text, user_id, user_tags and, for vectors, embedding.
    """
    depth = max(k, PER_CHANNEL)
    keyed = variants.where(F.col("variant_no") <= MAX_VARIANTS).withColumn(
        "_key", F.col("query_id") * MAX_VARIANTS + F.col("variant_no") - 1)
    labels = keyed.select(F.col("_key").alias("_k"), "query_id", "variant_no", F.col("variant_type").alias("query_type"))

    def tagged(hits: DataFrame, channel: str) -> DataFrame:
        return (hits.withColumnRenamed("query_id", "_k").join(labels, "_k").drop("_k").withColumn("channel", F.lit(channel)))

    asked = keyed.drop("query_id").withColumnRenamed("_key", "query_id")
    lists = tagged(lexical_topk(asked.select("query_id", "text", "user_id", "user_tags"), docs, depth), "BM25")
    if vectors is not None:
        dense = asked.where("embedding IS NOT NULL").select("query_id", "embedding", "user_id", "user_tags")
        lists = lists.unionByName(tagged(dense_topk(dense, vectors, depth), "VECTOR"))
    return lists


def degraded_channels(variants: DataFrame, lists: DataFrame, channels: tuple[str, ...] = ("BM25", "VECTOR")) -> DataFrame:
    """(query_id, variant_no, channel) of lists that came back empty."""
    expected = variants.where(F.col("variant_no") <= MAX_VARIANTS).select(
        "query_id", "variant_no", F.explode(F.array(*[F.lit(c) for c in channels])).alias("channel"))
    return expected.join(lists.select("query_id", "variant_no", "channel").distinct(),
                         ["query_id", "variant_no", "channel"], "left_anti")


def heuristic_rerank(hits: DataFrame, queries: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Order the first 40 fused hits by 0.7 term coverage and 0.3 scaled fusion score.

    Document text is fetched for the surviving hits only.
    """
    asked = queries.select("query_id", rerank_terms("text").alias("_q"))
    top = cut_lineage(hits.where(F.col("rank") <= RERANK_LIMIT).drop("rank"))
    body = only_ids(texts.select("doc_id", F.col("text").alias("_body")), top, "doc_id")
    # words are taken once per document, however many questions have it
    words = body.select("doc_id", rerank_terms("_body").alias("_words"))
    joined = top.join(asked, "query_id").join(words, "doc_id")
    n_query = F.size("_q")
    coverage = F.when(n_query > 0, F.size(F.array_intersect("_q", "_words")) / n_query).otherwise(0.0)
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("rrf_score", F.lit(0.0)) * RRF_SCALE))
    scored = joined.withColumn("rerank_score", F.round(LEXICAL_WEIGHT * coverage + RRF_WEIGHT * scaled, 9)).drop("_q", "_words")
    return first_rows(scored, ["query_id"], [F.desc("rerank_score"), F.desc_nulls_last("rrf_score"), F.asc("doc_id")], n, "rank")


def external_rerank(hits: DataFrame, scores: DataFrame, fallback: DataFrame, n: int) -> DataFrame:
    """Order by scores computed elsewhere (query_id, doc_id, score); a query without any score takes ``fallback``.

    Scores of unknown documents are dropped. Returns (query_id, doc_id, rank, rerank_score, strategy).
    """
    candidates = hits.where(F.col("rank") <= RERANK_LIMIT).drop("rank")
    matched = candidates.join(scores.select("query_id", "doc_id", F.col("score").alias("rerank_score")), ["query_id", "doc_id"])
    order = [F.desc("rerank_score"), F.asc("doc_id")]
    scored = first_rows(matched, ["query_id"], order, n, "rank").withColumn("strategy", F.lit("EXTERNAL"))
    rest = fallback.join(matched.select("query_id").distinct(), "query_id", "left_anti").withColumn("strategy", F.lit("HEURISTIC"))
    columns = ["query_id", "doc_id", "rank", "rerank_score", "strategy"]
    return scored.select(*columns).unionByName(rest.select(*columns))


def rerank(hits: DataFrame, queries: DataFrame, texts: DataFrame, n: int, scorer=None, enabled: bool = True) -> DataFrame:
    """Rerank with a plug-in: ``scorer`` takes (query_id, doc_id, query, text) rows and returns a ``score`` column."""
    if not enabled:
        return hits.where(F.col("rank") <= n)
    if scorer is not None:
        # read three times below: by the scorer, the join of its scores and the fallback
        hits = cut_lineage(hits)
    fallback = heuristic_rerank(hits, queries, texts, n)
    if scorer is None:
        return fallback
    pairs = (hits.where(F.col("rank") <= RERANK_LIMIT).select("query_id", "doc_id")
             .join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(texts.select("doc_id", "text"), "doc_id"))
    return external_rerank(hits, scorer(pairs).where("score IS NOT NULL"), fallback, n)


def assemble_parents(hits: DataFrame, children: DataFrame, parents: DataFrame, k: int) -> DataFrame:
    """Best child per parent, parent text swapped in, first ``k`` per query ranked again.

    ``hits``: query_id, child_id, rank. ``children``: child_id, doc_id, parent_id (null allowed), text.
    ``parents``: parent_id, parent_text. Adds n_candidates and n_dropped (children folded into a kept parent).
    """
    keyed = hits.join(children, "child_id").withColumn(
        "parent_key", F.coalesce(F.concat(F.lit("p"), F.col("parent_id").cast("string")), F.concat(F.lit("c"), F.col("child_id").cast("string"))))
    totals = keyed.groupBy("query_id").agg(F.count("*").alias("n_candidates"), F.countDistinct("parent_key").alias("_groups"))
    best = first_rows(keyed, ["query_id", "parent_key"], [F.asc("rank"), F.asc("child_id")])
    kept = first_rows(best.withColumnRenamed("rank", "child_rank"), ["query_id"], [F.asc("child_rank"), F.asc("child_id")], k, "rank")
    widened = kept.join(parents, "parent_id", "left").withColumn("expanded", F.col("parent_text").isNotNull())
    return (widened.withColumn("text", F.coalesce("parent_text", "text")).drop("parent_text")
            .join(totals.select("query_id", "n_candidates", (F.col("n_candidates") - F.col("_groups")).alias("n_dropped")), "query_id"))


