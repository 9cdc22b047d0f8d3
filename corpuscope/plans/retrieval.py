"""Retrieval queries: both channels, fusion, reranking, parent assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope import session
from corpuscope.operators import access, dense, fuse, ivf, postings
from corpuscope.plans import fragments as sql
from corpuscope.plans.bindings import Tables
from corpuscope.plans.registry import query
from corpuscope.session import cut_lineage
from corpuscope.streaming.pipeline import scratch_path


def asked(t: Tables):
    """Questions with the tags of their user. Kept in memory: every channel reads them."""
    return t.once("asked", lambda: access.with_effective_tags(t.questions, t.users, t.org_tags).persist())


def asked_vectors(t: Tables):
    return asked(t).drop("text").join(t.question_vectors.select("query_id", "embedding"), "query_id")


def asked_both(t: Tables):
    return asked(t).join(t.question_vectors.select("query_id", "embedding"), "query_id", "left")


def stored_once(t: Tables, name: str, write, read):
    """What ``read(path)`` finds at a path of the shared folder that ``write(path)`` has filled, once for the input files of a session."""
    known = t.spark.sparkContext.__dict__.setdefault("_corpuscope_stored", {})
    key = (name, t.folder, tuple(sorted(t.documents.inputFiles() + t.embeddings.inputFiles())))
    found = read(known[key]) if key in known else None
    if found is None:
        known[key] = scratch_path(t.spark, name)
        write(known[key])
        found = read(known[key])
    return found


def index_of(t: Tables) -> postings.Postings:
    """The postings of the documents, as their ingestion leaves them."""
    return t.once("postings", lambda: stored_once(t, "postings", lambda path: postings.write_postings(t.docs, path), lambda path: postings.open_postings(t.spark, path)))


BM = f"WITH RECURSIVE {sql.EFFECTIVE}, {sql.bm25('questions', 'docs', acl=True)}"
PLAIN_BM = f"WITH {sql.bm25('questions', 'docs', acl=False)}"
DENSE_ALL = f"dn_scores AS ({sql.dense('question_vectors', 'vectors', acl=True)})"
LISTS = f"""{BM}, {DENSE_ALL}, lists AS (
    SELECT query_id, doc_id, rank, score, 'BM25' AS channel FROM ({sql.topk('bm_scores', 40, where='WHERE score >= 0.3')}) a
    UNION ALL SELECT query_id, doc_id, rank, score, 'VECTOR' FROM ({sql.topk('dn_scores', 40)}) b)"""
FUSED = f"""{LISTS}, fused AS (SELECT query_id, doc_id, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 12) AS rrf_score, count(*) AS n_hits,
    CASE WHEN count(DISTINCT channel) = 2 THEN 'HYBRID_RRF' WHEN max(channel) = 'VECTOR' THEN 'VECTOR_ONLY' ELSE 'BM25_ONLY' END
    AS retrieval_mode FROM lists GROUP BY query_id, doc_id)"""
_R6 = "score"


def lists_of(t: Tables):
    lexical = fuse.ranked(postings.lexical_topk(asked(t), index_of(t), 40), "BM25")
    return lexical.unionByName(fuse.ranked(dense.dense_topk(asked_vectors(t), t.vectors, 40), "VECTOR"))


@query("f01_bm25_topk", f"{BM} SELECT query_id, doc_id, rank, {_R6} FROM ({sql.topk('bm_scores', 10, where='WHERE score >= 0.3')}) x")
def _bm25(t):
    return postings.lexical_topk(asked(t), index_of(t), 10)


@query("f02_bm25_all_terms_rescore", f"""{PLAIN_BM}, w AS ({sql.topk('bm_scores', 300)}),
    f AS (SELECT query_id, doc_id, round(0.2::DOUBLE * score + CASE WHEN matched = n_terms THEN score ELSE 0 END, 9) AS score FROM w)
    SELECT query_id, doc_id, rank, {_R6} FROM ({sql.topk('f', 10)}) x""")
def _rescore(t):
    return postings.all_terms_rescore(t.questions, index_of(t), 10, 300, open_access=True)


@query("f03_dense_topk", f"""WITH RECURSIVE {sql.EFFECTIVE}, {DENSE_ALL}
    SELECT query_id, doc_id, rank, {_R6} FROM ({sql.topk('dn_scores', 10)}) x""")
def _dense(t):
    return dense.dense_topk(asked_vectors(t), t.vectors, 10)


def inverted(t: Tables) -> ivf.InvertedFile:
    """The inverted file of the vectors, as their ingestion leaves it."""
    return t.once("inverted", lambda: stored_once(t, "inverted", lambda path: ivf.write_inverted(t.vectors, path), lambda path: ivf.open_inverted(t.spark, path)))


@query("f04_approximate_topk")
def _approximate(t):
    return ivf.search(asked_vectors(t), inverted(t), 10).hits


@query("f04_approximate_check", f"""WITH RECURSIVE {sql.EFFECTIVE}, {DENSE_ALL}
    SELECT query_id, least(count(*), 10) AS n_hits, least(count(*), 10) AS n_true FROM dn_scores GROUP BY query_id""")
def _approximate_check(t):
    # whatever candidates were found: each question has its k hits (or all that its user sees), and each hit its true score
    hits = cut_lineage(ivf.search(asked_vectors(t), inverted(t), 10).hits)
    seen = access.with_effective_tags(t.question_vectors.select("query_id", "user_id", F.col("embedding").alias("q")), t.users, t.org_tags)
    pairs = hits.join(seen, "query_id").join(session.only_ids(t.vectors, hits, "doc_id"), "doc_id").where(access.visible())
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    cosine = dot(F.col("q"), F.col("embedding")) / F.sqrt(dot(F.col("q"), F.col("q")) * dot(F.col("embedding"), F.col("embedding")))
    right = F.abs((1 + cosine) / 2 - F.col("score")) < 2e-9
    true = pairs.where(right).groupBy("query_id").agg(F.count("*").alias("n_true"))
    return hits.groupBy("query_id").agg(F.count("*").alias("n_hits")).join(true, "query_id", "left").select("query_id", "n_hits", F.coalesce("n_true", F.lit(0)).alias("n_true"))


@query("f05_legacy_hybrid", f"""{PLAIN_BM}, d AS ({sql.dense('question_vectors', 'vectors', acl=False)}),
    dk AS ({sql.topk('d', 300)}),
    j AS (SELECT query_id, doc_id, round(coalesce(dk.score, 0) + coalesce(b.score, 0), 9) AS first, matched, n_terms, b.score AS bm
      FROM dk FULL OUTER JOIN bm_scores b USING (query_id, doc_id)),
    w AS ({sql.topk('j', 300, score='first')}),
    f AS (SELECT query_id, doc_id, round(0.2::DOUBLE * first + coalesce(CASE WHEN matched = n_terms THEN bm END, 0), 9) AS score FROM w)
    SELECT query_id, doc_id, rank, {_R6} FROM ({sql.topk('f', 10)}) x""")
def _legacy(t):
    vectors = t.question_vectors.select("query_id", "embedding")
    queries = t.questions.join(vectors, "query_id")
    return fuse.legacy_hybrid(queries, t.docs, t.vectors, 10)


@query("f06_hybrid_search", f"""{FUSED} SELECT x.query_id, x.doc_id, rrf_score, n_hits, retrieval_mode, rank, f.file_name
    FROM ({sql.topk('fused', 10, score='rrf_score')}) x LEFT JOIN files f ON f.doc_id = x.doc_id""")
def _hybrid(t):
    found = fuse.hybrid_search(asked_both(t), index_of(t), t.vectors, 10)
    return fuse.attach_names(found, t.files)


@query("f07_reciprocal_rank_fusion", f"""{FUSED}
    SELECT query_id, doc_id, rrf_score, n_hits, rank FROM ({sql.topk('fused', 40, score='rrf_score')}) x""")
def _rrf(t):
    return fuse.rrf(lists_of(t), 40).select("query_id", "doc_id", "rrf_score", "n_hits", "rank")


@query("f08_hit_provenance", f"""{FUSED}, k AS ({sql.topk('fused', 10, score='rrf_score')})
    SELECT k.query_id, k.doc_id, k.retrieval_mode,
      string_agg(l.channel || '#' || CAST(l.rank AS VARCHAR), ';' ORDER BY l.channel) AS hits,
      round(sum(CAST(1 AS DOUBLE) / (60 + l.rank)), 9) AS contribution
    FROM k JOIN lists l ON l.query_id = k.query_id AND l.doc_id = k.doc_id GROUP BY ALL""")
def _provenance(t):
    lists = cut_lineage(lists_of(t))
    found = fuse.provenance(lists, fuse.rrf(lists, 10))
    text = F.transform("hits", lambda h: F.concat(h["channel"], F.lit("#"), h["rank"].cast("string")))
    total = F.aggregate("hits", F.lit(0.0), lambda a, h: a + h["rrf_contribution"])
    return found.select("query_id", "doc_id", "retrieval_mode", F.array_join(text, ";").alias("hits"),
                        F.round(total, 9).alias("contribution"))


RERANK_TERMS = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9一-龥]+'), lambda t: length(t) > 1))"


def rerank_sql(source: str, n: int) -> str:
    """Heuristic rerank of the fused rows in ``source`` (query_id, doc_id, rrf_score, rank <= 40)."""
    q, d = RERANK_TERMS.format(c="q.text"), RERANK_TERMS.format(c="d.text")
    return f"""SELECT query_id, doc_id, rrf_score, retrieval_mode, round(0.7::DOUBLE * (CASE WHEN len(qt) = 0 THEN 0
          ELSE CAST(len(list_intersect(qt, dt)) AS DOUBLE) / len(qt) END)
          + 0.3::DOUBLE * least(1, greatest(0, rrf_score * 30)), 9) AS rerank_score
        FROM (SELECT s.query_id, s.doc_id, s.rrf_score, s.retrieval_mode, {q} AS qt, {d} AS dt
          FROM {source} s JOIN questions q ON q.query_id = s.query_id JOIN docs d ON d.doc_id = s.doc_id) x"""


RERANKED = f"""{FUSED}, top40 AS ({sql.topk('fused', 40, score='rrf_score')}), rr AS ({rerank_sql('top40', 8)}),
    hr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rrf_score DESC, doc_id)
      AS rank FROM rr) y WHERE rank <= 8)"""


@query("f10_heuristic_rerank", f"""{RERANKED}
    SELECT query_id, doc_id, rank, rerank_score, retrieval_mode FROM hr""")
def _rerank(t):
    top = fuse.heuristic_rerank(fuse.rrf(lists_of(t), fuse.FUSION_LIMIT), t.questions, t.docs, 8)
    return top.select("query_id", "doc_id", "rank", "rerank_score", "retrieval_mode")


def vector_scores(t: Tables):
    """Scores of an outside model, for the queries whose id is not a multiple of three: here the vector channel's."""
    scored = dense.dense_topk(asked_vectors(t), t.vectors, 100)
    return scored.where(F.col("query_id") % 3 != 0).select("query_id", "doc_id", "score")


@query("f11_external_rerank", f"""{RERANKED}, ext AS (SELECT * FROM ({sql.topk('dn_scores', 100)}) e
      WHERE query_id % 3 <> 0),
    m AS (SELECT c.query_id, c.doc_id, e.score AS rerank_score FROM top40 c JOIN ext e ON e.query_id = c.query_id AND e.doc_id = c.doc_id),
    mk AS ({sql.topk('m', 8, score='rerank_score')})
    SELECT query_id, doc_id, rank, rerank_score, 'EXTERNAL' AS strategy FROM mk
    UNION ALL SELECT query_id, doc_id, rank, rerank_score, 'HEURISTIC' FROM hr
      WHERE query_id NOT IN (SELECT query_id FROM m)""")
def _external(t):
    hits = cut_lineage(fuse.rrf(lists_of(t), fuse.FUSION_LIMIT))
    fallback = fuse.heuristic_rerank(hits, t.questions, t.docs, 8)
    return fuse.external_rerank(hits, vector_scores(t), fallback, 8)


@query("l02_pluggable_reranker", f"""{FUSED}, top40 AS ({sql.topk('fused', 40, score='rrf_score')}),
    s AS (SELECT c.query_id, c.doc_id, CAST(len(list_intersect(list_distinct({sql.tokens('q.text')}), list_distinct({sql.tokens('d.text')}))) AS DOUBLE)
      AS score FROM top40 c JOIN questions q ON q.query_id = c.query_id JOIN docs d ON d.doc_id = c.doc_id)
    SELECT query_id, doc_id, rank, score AS rerank_score, 'EXTERNAL' AS strategy FROM ({sql.topk('s', 8)}) x""")
def _plug_rerank(t):
    from corpuscope.functions.text import memory_terms

    def shared_words(pairs):
        return pairs.withColumn("score", F.size(F.array_intersect(memory_terms("query"), memory_terms("text"))).cast("double"))

    return fuse.rerank(fuse.rrf(lists_of(t), fuse.FUSION_LIMIT), t.questions, t.docs, 8, scorer=shared_words)
