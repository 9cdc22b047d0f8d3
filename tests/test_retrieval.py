"""Search operators: fusion goldens, leak tests, the ways taken for large sides, refinement."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope import session
from corpuscope.functions import rules as R
from corpuscope.operators import access, agentic, bm25, dense, evidence, fuse
from corpuscope.plans import agentic as agentic_plans
from corpuscope.plans.retrieval import asked, asked_vectors


def test_document_in_both_lists_wins(spark):
    lists = spark.createDataFrame(
        [(1, "a", 1, "VECTOR"), (1, "b", 2, "VECTOR"), (1, "b", 1, "BM25"), (1, "c", 2, "BM25")], "query_id int, doc_id string, rank int, channel string")
    rows = fuse.rrf(lists, 10).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == ["b", "a", "c"]
    assert rows[0]["retrieval_mode"] == "HYBRID_RRF" and rows[0]["n_hits"] == 2
    assert rows[0]["rrf_score"] == pytest.approx(1 / 61 + 1 / 62)
    flipped = fuse.rrf(lists.orderBy(F.desc("rank")), 10).orderBy("rank").collect()
    assert [tuple(r) for r in flipped] == [tuple(r) for r in rows]


def visible_pairs(tables, docs):
    tags = {}
    for r in access.effective_tags(tables.users, tables.org_tags).collect():
        tags.setdefault(r["user_id"], set()).add(r["tag"])
    info = {r["doc_id"]: r for r in docs.select("doc_id", "owner_id", "org_tag", "is_public").collect()}
    return lambda user, doc: info[doc]["is_public"] or info[doc]["owner_id"] == user or info[doc]["org_tag"] in tags.get(user, set())


@pytest.mark.parametrize("channel", ["bm25", "dense"])
def test_no_invisible_row_leaks(tables, channel):
    users = {r["query_id"]: r["user_id"] for r in asked(tables).select("query_id", "user_id").collect()}
    if channel == "bm25":
        docs, rows = tables.docs, bm25.bm25_topk(asked(tables), tables.docs, 20).collect()
    else:
        docs, rows = tables.vectors, dense.dense_topk(asked_vectors(tables), tables.vectors, 20).collect()
    may_see = visible_pairs(tables, docs)
    assert rows and all(may_see(users[r["query_id"]], r["doc_id"]) for r in rows)


def test_user_without_identity_sees_public_rows_only(spark, tables):
    stranger = spark.createDataFrame([(1, "the and that", -5)], "query_id long, text string, user_id long")
    rows = bm25.bm25_topk(access.with_effective_tags(stranger, tables.users, tables.org_tags), tables.docs, 50)
    assert rows.join(tables.docs, "doc_id").where("NOT is_public").count() == 0 and rows.count() > 0


def test_salted_join_equals_broadcast_join(tables, monkeypatch):
    queries = asked(tables)
    plain = bm25.bm25_topk(queries, tables.docs, 10).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(bm25, "BROADCAST_CELLS", 0)
    salted = bm25.bm25_topk(queries, tables.docs, 10).orderBy("query_id", "rank").collect()
    assert salted == plain


def test_search_without_identity_is_refused(tables):
    queries = tables.questions.select("query_id", "text")
    vectors = tables.question_vectors.select("query_id", "embedding")
    for search in (lambda: bm25.bm25_topk(queries, tables.docs, 5), lambda: dense.dense_topk(vectors, tables.vectors, 5)):
        with pytest.raises(ValueError, match="open_access"):
            search()


def test_grid_search_equals_scan_search(tables):
    queries = asked_vectors(tables)
    scan = dense.dense_topk(queries, tables.vectors, 7).orderBy("query_id", "rank").collect()
    grid = dense.dense_topk(queries, tables.vectors, 7, query_blocks=3, document_blocks=4).orderBy("query_id", "rank").collect()
    assert grid == scan


def test_dense_scores_equal_brute_force(tables):
    q = {r["query_id"]: np.array(r["embedding"], dtype=float) for r in tables.question_vectors.collect()}
    d = {r["doc_id"]: np.array(r["embedding"], dtype=float) for r in tables.vectors.collect()}
    rows = dense.dense_topk(tables.question_vectors.select("query_id", "embedding"), tables.vectors.select("doc_id", "embedding"), 5, open_access=True).collect()
    for query, vector in q.items():
        score = {k: round((1 + float(vector @ v / np.linalg.norm(vector) / np.linalg.norm(v))) / 2, 9) for k, v in d.items()}
        want = sorted(score, key=lambda k: (-score[k], k))[:5]
        got = [r["doc_id"] for r in sorted((r for r in rows if r["query_id"] == query), key=lambda r: r["rank"])]
        assert got == want


def test_large_side_check_reads_a_bounded_number_of_rows(spark):
    assert session.fits_broadcast(spark.range(10), 10) and not session.fits_broadcast(spark.range(11), 10)


def plan_of(spark, text):
    return R.query_plans(spark.createDataFrame([(1, text)], "query_id long, text string"))


def test_comparison_is_decomposed_and_original_kept(spark):
    rows = R.query_variants(plan_of(spark, "对比 Redis 与 Kafka 的消息可靠性，以及各自的适用场景")).orderBy("variant_no").collect()
    assert rows[0]["variant_type"] == "ORIGINAL" and rows[0]["intent"] == "COMPARE" and len(rows) <= 4
    assert any(r["variant_type"] == "DECOMPOSED" for r in rows)


def test_vague_action_asks(spark):
    assert plan_of(spark, "帮我修改一下").first()["missing_slots"] == ["actionTarget"]
    assert plan_of(spark, "帮我修改报销流程文档").first()["missing_slots"] == []


def test_planner_text_is_parsed_leniently(spark):
    raw = 'Sure: {"intent":"compare","complexity":"odd","entities":[" A ",""],"confidence":7,"missingSlots":["x"]} ok'
    row = R.parse_plans(spark.createDataFrame([(raw,), ("no json",)], "output string")).collect()
    assert row[0]["intent"] == "COMPARE" and row[0]["complexity"] == "SIMPLE" and row[0]["entities"] == ["A"] and row[0]["confidence"] == 1.0
    assert row[1]["intent"] == "KNOWLEDGE_QA" and row[1]["entities"] == []


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, file_name string, anchor_text string, matched string, text string")


def assessed(spark, text, rows, **kw):
    asked_ = evidence.required_aspects(plan_of(spark, text))
    return evidence.assess(asked_, hits(spark, rows), **kw).first()


def test_no_hits_are_insufficient(spark):
    row = assessed(spark, "redis cache", [])
    assert row["status"] == "INSUFFICIENT" and row["confidence"] == 0.95 and row["action"] == "REFINE_RETRIEVAL"
    assert assessed(spark, "redis cache", [], refinement_round=2)["action"] == "ABSTAIN"


def test_every_aspect_is_needed(spark):
    text = "对比 Redis 缓存策略 以及 Kafka 消息模型"
    only_one = [(1, 1, "f", None, None, "Redis 缓存策略 说明"), (1, 2, "f", None, None, "Redis 缓存策略 细节")]
    row = assessed(spark, text, only_one)
    assert row["status"] == "PARTIAL" and row["missing"]
    both = only_one + [(1, 3, "f", None, None, "Kafka 消息模型 说明 对比")]
    assert assessed(spark, text, both)["status"] == "SUFFICIENT"


def test_opposite_answers_conflict(spark):
    rows = [(1, 1, "f", None, None, "系统支持导出"), (1, 2, "f", None, None, "系统不支持导出")]
    assert assessed(spark, "系统是否支持导出", rows)["status"] == "CONFLICTED"


def test_corrective_queries_skip_what_ran(spark):
    asked_ = evidence.required_aspects(plan_of(spark, "对比 Redis 缓存策略 以及 Kafka 消息模型"))
    judged = evidence.assess(asked_, hits(spark, []))
    none = spark.createDataFrame([], "query_id long, fp string")
    first = evidence.corrective_queries(asked_, judged, none).orderBy("variant_no").collect()
    assert 1 <= len(first) <= 3
    ran = spark.createDataFrame([(1, first[0]["fp"])], "query_id long, fp string")
    again = evidence.corrective_queries(asked_, judged, ran).collect()
    assert first[0]["fp"] not in {r["fp"] for r in again}


STAGES = ("QUERY_PLANNING", "PARALLEL_RECALL", "RRF_FUSION", "RERANK", "PARENT_CONTEXT_ASSEMBLY", "EVIDENCE_VERIFY")


def test_refinement_is_bounded_and_keeps_every_question(tables):
    plans = agentic_plans.plans(tables)
    out = agentic.retrieve(plans, tables.docs, tables.vectors, tables.files, 8)
    rows = out.assessments.collect()
    assert sorted(r["query_id"] for r in rows) == sorted(r["query_id"] for r in tables.questions.collect())
    assert max(r["round"] for r in rows) <= 2
    assert out.hits.groupBy("query_id").count().where("count > 8").count() == 0
    trace = out.trace.collect()
    assert {r["stage"] for r in trace if r["round"] == 0} == set(STAGES)
    again = {r["stage"] for r in trace if r["round"] == 1}
    assert again == {"CORRECTIVE_RECALL_1", *(f"{s}_1" for s in STAGES[2:])}
    # a question that went on has all stages of its round, and one that stopped says why
    reasons = {(r["query_id"], r["round"], r["reason"].split(":")[0]) for r in out.degradations.collect()}
    last = {r["query_id"]: r["round"] for r in rows}
    open_ = {r["query_id"] for r in rows if r["status"] in ("PARTIAL", "INSUFFICIENT") and last[r["query_id"]] < 2}
    assert open_ <= {q for q, _, reason in reasons if reason.startswith("EVIDENCE_REFINE_")}


def test_plans_without_retrieval_stop_after_planning(tables):
    plans = agentic_plans.plans(tables).withColumn("retrieval_required", F.col("query_id") % 2 == 0).withColumn("embedding", F.when(F.col("query_id") % 4 == 0, F.col("embedding")))
    out = agentic.retrieve(plans, tables.docs, tables.vectors, tables.files, 8, max_rounds=0)
    stages = {}
    for r in out.trace.collect():
        stages.setdefault(r["query_id"], []).append((r["stage"], r["status"]))
    assert all(len(s) == (6 if q % 2 == 0 else 1) for q, s in stages.items()) and {q % 2 for q in stages} == {0, 1}
    assert {r["query_id"] % 2 for r in out.assessments.collect()} == {0}
    # the vector channel of every other question could not be asked
    assert all(("PARALLEL_RECALL", "DEGRADED" if q % 4 else "SUCCEEDED") in s for q, s in stages.items() if q % 2 == 0)
    assert {r["query_id"] % 4 for r in out.degradations.collect()} == {2} and "no embedding" in out.degradations.first()["reason"]
    off = agentic.retrieve(plans, tables.docs, tables.vectors, tables.files, 8, enabled=False)
    assert off.hits.count() == off.assessments.count() == 0 and {r["stage"] for r in off.trace.collect()} == {"QUERY_PLANNING"}


def test_parents_take_the_place_of_their_children(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, doc_id long, rank int")
    docs = spark.createDataFrame([(10, "child ten"), (11, "child eleven"), (12, "alone"), (13, "never hit")], "doc_id long, text string")
    files = spark.createDataFrame([(i, f"f{i}") for i in (10, 11, 12)], "doc_id long, file_name string")
    children = spark.createDataFrame([(10, 7), (11, 7), (12, None)], "doc_id long, parent_id long")
    parents = spark.createDataFrame([(7, "Heading of seven.\nchild ten and child eleven"), (8, "other")], "parent_id long, parent_text string")
    rows = agentic.assembled(ranked, docs, files, children, parents, 5).orderBy("rank").collect()
    assert [(r["doc_id"], r["text"], r["matched"], r["expanded"], r["n_dropped"]) for r in rows] == [
        (10, "Heading of seven.\nchild ten and child eleven", "child ten", True, 1), (12, "alone", "alone", False, 1)]
    assert rows[0]["anchor_text"] == "Heading of seven. child ten and child eleven"


def test_bm25_formula(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "cat cat bird"), (3, "fish fish")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "cat")], "query_id long, text string")
    got = {r["doc_id"]: r["score"] for r in bm25.bm25_scores(queries, docs, open_access=True).collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5))
    want = {d: idf * tf / (tf + 1.2 * (0.25 + 0.75 * dl / (7 / 3))) for d, tf, dl in ((1, 1, 2), (2, 2, 3))}
    assert got == pytest.approx(want, abs=1e-8)


def test_access_in_rows_of_files_not_of_users(spark):
    """Files that come twice, under other tags and by other owners, against pairs by hand; bitmaps and listed files do not grow with the users."""
    people = [(i, "A" if i % 2 else ("B,C" if i % 3 else "")) for i in range(300)] + [(1, "A")]
    users = spark.createDataFrame(people, "user_id long, org_tags string")
    tags = spark.createDataFrame([("A", "R"), ("B", "R"), ("C", None), ("R", None), ("DEFAULT", None)], "tag_id string, parent_tag string")
    rows = [(i, i % 7 if i % 5 else None, ["A", "B", "C", "R", "DEFAULT", "X", None][i % 7], i % 6 == 0) for i in range(40_000, 40_200)]
    rows += [(40_001, 2, "C", False), (40_002, 900, "B", False), (40_003, 3, "A", None), (40_003, 3, "A", None), (5, 4, "X", None)]
    files = spark.createDataFrame(rows, "doc_id long, owner_id long, org_tag string, is_public boolean")
    held = {u: {"DEFAULT", *(["A", "R"] if u % 2 else ["B", "C", "R"] if u % 3 else [])} for u in range(300)}
    pairs = {u: [(d, o == u and [1, 2][u == 1] or 1) for d, o, t, p in rows if not p and (o == u or t in held[u])] for u in held}
    public = [d for d, _, _, p in rows if p]

    found = access.accessible_files(users, tags, files)
    assert found.count() <= 3 * len(rows)
    totals = {r["user_id"]: (r["n"], r["id_sum"]) for r in access.accessible_totals(users, tags, found).collect()}
    assert totals == {u: (sum(n for _, n in p), sum(d * n for d, n in p)) for u, p in pairs.items()}
    bitmaps = access.access_bitmaps(users, tags, files)
    assert bitmaps.count() <= len(rows)
    counts = {r["user_id"]: r["documents"] for r in access.visible_counts(users, tags, bitmaps).collect()}
    assert counts == {u: len({d for d, _ in p}) + len(set(public)) for u, p in pairs.items()}
    asked = [(u, d) for u in [*range(9), 77, 900, None] for d in sorted({r[0] for r in rows})] + [(1, 40_001)] * 2 + [(1, None), (1, 10**9)]
    got = access.sees(spark.createDataFrame(asked, "user_id long, doc_id long"), users, tags, bitmaps).collect()
    sees = {u: {d for d, _ in p} for u, p in pairs.items()}
    assert sorted(map(str, ((r["user_id"], r["doc_id"], r["visible"]) for r in got))) == sorted(str((u, d, d in public or d in sees.get(u, ()))) for u, d in asked)
