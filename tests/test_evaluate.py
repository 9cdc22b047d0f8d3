"""Evaluation goldens."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import evaluate as E
from corpuscope.operators import traces
from corpuscope.sources import golden


def test_retrieval_metrics_golden(spark):
    ranked = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(["m7", "m2", "m9", "m4", "m1", "m5"])], "query_id int, doc_id string, rank int")
    qrels = spark.createDataFrame([(1, "m7"), (1, "m4"), (1, "m8"), (1, "m4")], "query_id int, doc_id string")
    row = E.retrieval_cases(ranked, qrels, 5).first()
    # hits at ranks 1 and 4 of three relevant: (1 + 1/log2 5) / (1 + 1/log2 3 + 1/2)
    assert (row["recall_at_k"], row["reciprocal_rank"], row["ndcg_at_k"], row["hits"]) == (0.6667, 1.0, 0.6714, 2)


def attempt(case, index, passed, expected_clar, actual_clar, duplicates, total, latency, **signals):
    base = {"expectedIntent": "COMPARE", "actualIntent": "compare", "expectedEvidenceStatus": "", "actualEvidenceStatus": "", "expectedConflict": False,
            "actualConflict": False, "recoveryAttempt": False, "recoverySucceeded": False, "reusedStepCount": 0, "duplicateSideEffectCount": 0,
            "writeActionCount": 0, "latencyMs": latency, "promptTokens": 10, "completionTokens": 5}
    return {"caseId": case, "attemptIndex": index, "expectedClarification": expected_clar, "actualClarification": actual_clar,
            "expectedClarificationSlots": [], "actualClarificationSlots": [], "expectedTrajectory": ["plan", "search", "answer"],
            "actualTrajectory": ["plan", "SEARCH ", "answer"], "expectedTools": [{"name": "search", "argumentsFingerprint": "x"}],
            "actualTools": [{"name": "Search", "argumentsFingerprint": "X"}], "expectedCitationIds": ["1"], "actualCitationIds": ["1", "2"],
            "requiredClaimIds": ["c1", "c2"], "supportedClaimIds": ["c1"], "duplicateActionCount": duplicates, "totalActionCount": total,
            "expectedTerminalReason": "ANSWERED", "actualTerminalReason": "answered", "passed": passed, "signals": {**base, **signals}}


@pytest.fixture()
def attempts(spark, tmp_path):
    rows = [attempt("k1", 1, False, True, True, 2, 5, 400), attempt("k1", 2, True, False, True, 0, 3, 2100, recoveryAttempt=True, recoverySucceeded=True),
            attempt("k2", 1, True, True, True, 0, 0, 650), attempt("k2", 2, True, True, False, 0, 2, 800)]
    path = tmp_path / "golden.json"
    path.write_text(json.dumps({"attempts": rows}, indent=1), encoding="utf-8")
    return golden.read_agent_golden(spark, str(path))


def test_agent_report_golden(attempts):
    report = E.agent_report(attempts).first()
    # two true positives, one false positive, one false negative; 2 of 10 actions repeated; k1 fails its first attempt
    assert report["clarification_f1"] == 0.6667
    assert report["duplicate_action_rate"] == 0.2
    assert (report["pass_at_1"], report["pass_power_k"], report["observed_k"]) == (0.5, 0.5, 2)
    assert report["p95_latency_ms"] == 2100 and report["resume_success_rate"] == 1.0 and report["total_tokens"] == 60
    assert report["trajectory_score"] == 1.0 and report["tool_argument_accuracy"] == 1.0 and report["tool_selection_f1"] == 1.0
    assert report["citation_f1"] == 0.6667 and report["claim_coverage"] == 0.5 and report["intent_macro_f1"] == 1.0
    gate = E.gate(E.agent_report(attempts), E.AGENT_GATES)
    assert gate.count() == len(E.AGENT_GATES) and not gate.first()["gate_passed"]


def test_repeated_attempts_are_rejected(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), (" ", 1), ("b", 0), ("c", 1)], "case_id string, attempt_index int")
    assert {r["reason"] for r in E.invalid_attempts(rows).collect()} == {"REPEATED", "BLANK_CASE", "INDEX_BELOW_ONE"}


def test_empty_sides_score_one(spark):
    row = spark.range(1).select(E.set_f1(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("f"),
                                E.trajectory_score(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("t")).first()
    assert tuple(row) == (1.0, 1.0)


def test_longest_common_subsequence(spark):
    def plain(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
        return best[-1][-1]

    import random

    rng = random.Random(3)
    rows = [(i, [rng.choice("abc") for _ in range(rng.randint(0, 7))], [rng.choice("abc") for _ in range(rng.randint(0, 7))]) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>")
    got = {r["id"]: r["n"] for r in df.select("id", E.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {i: plain(a, b) for i, a, b in rows}


def test_subsequence_and_invalid_transitions(spark):
    df = spark.createDataFrame([(["plan", "", "answer"], ["plan", "x", "search", "ANSWER"]), (["a", "b"], ["b", "a"])], "e array<string>, a array<string>")
    rows = df.select(E.is_subsequence(F.col("e"), F.col("a")).alias("s"), E.invalid_transition_rate(F.col("e"), F.col("a")).alias("r")).collect()
    assert [r["s"] for r in rows] == [True, False] and rows[1]["r"] == 1.0


def test_cases_with_too_few_runs_are_rejected(spark):
    cases = spark.createDataFrame([("a", ["g1", "g2"]), ("b", ["g3"])], "case_id string, generation_ids array<string>")
    runs = spark.createDataFrame([("g1", 1), ("g2", 2), ("g3", 3)], "generation_id string, x int")
    attempts, rejects = traces.attempts_of_cases(cases, runs, 2)
    assert attempts.count() == 2 and [r["case_id"] for r in rejects.collect()] == ["b"]


def test_retrieval_golden_reader(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"id":"1","query":"q","relevantDocumentIds":["m:1","m:1","m:2"],"topK":5}\n{"id":"2","query":"r","relevantDocumentIds":[]}\n')
    cases, qrels = golden.read_retrieval_golden(spark, str(tmp_path / "g.jsonl"))
    assert {(r["case_id"], r["k"]) for r in cases.collect()} == {("1", 5), ("2", 8)} and qrels.count() == 2


def test_every_condition_of_the_pass_rule(spark):
    sides = {"expected_trajectory": ["plan", "answer"], "trajectory": ["plan", "x", "Answer"], "expected_intent": "ASK", "intent": " ask", "expected_conflict": False, "conflict": False,
             "expected_clarification": True, "clarification": True, "expected_evidence_status": "FULL", "evidence_status": "full ", "expected_terminal_reason": "done", "terminal_reason": "DONE",
             "expected_tools": [("search", "F1")], "tools": [("other", "f2"), (" Search", "f1")], "expected_citations": ["C1"], "citations": ["c2", "c1 "], "required_claims": ["k1"], "supported_claims": ["K1"]}
    wrong = [{"trajectory": ["answer", "plan"]}, {"intent": "tell"}, {"conflict": True}, {"clarification": False}, {"evidence_status": "none"}, {"terminal_reason": None},
             {"tools": [("search", "f2"), ("other", "f1")]}, {"tools": None}, {"citations": ["c2"]}, {"citations": None}, {"supported_claims": []}]
    right = [{}, {"expected_tools": None, "tools": None}, {"required_claims": [], "supported_claims": None}, {"expected_evidence_status": " ", "evidence_status": "none"}]
    kinds = {"expected_trajectory": "array<string>", "trajectory": "array<string>", "expected_conflict": "boolean", "conflict": "boolean", "expected_clarification": "boolean",
             "clarification": "boolean", "expected_tools": "array<struct<name:string,fingerprint:string>>", "tools": "array<struct<name:string,fingerprint:string>>",
             "expected_citations": "array<string>", "citations": "array<string>", "required_claims": "array<string>", "supported_claims": "array<string>"}
    df = spark.createDataFrame([(n, *(sides | change).values()) for n, change in enumerate(right + wrong)], "n int, " + ", ".join(f"{c} {kinds.get(c, 'string')}" for c in sides))
    rows = df.select("n", traces.passed(**{c: F.col(c) for c in sides}).alias("passed")).collect()
    assert [r["passed"] for r in sorted(rows)] == [True] * len(right) + [False] * len(wrong)


def test_only_documents_that_hold_a_text_are_cut_into_words(spark, tmp_path):
    """The rows of ``qrels`` are those of its SQL over all documents; the documents that hold no benchmark text are left out before words are made."""
    from corpuscope.operators import holding
    from corpuscope.plans.bindings import SQL, Tables

    items = [(1, "one two three four five six"), (2, "Grüße an alle fünf von hier"), (3, None), (4, "one two three nine ten eleven")]
    texts = ["x one two three four five six y", "one two three four five six", "one two three four five", None, "", "ab Grüße an alle fünf von hier", "one two three nine ten eleven one two three four five six",
             "one two", "three four five six", "x " * 3_000 + items[1][1], "Grüße an alle fünf von hie"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for name, table in (("documents", docs), ("benchmark", benchmark)):
        table.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    t = Tables(spark, str(tmp_path))
    want = {tuple(r) for r in spark.sql(SQL["qrels"][0], documents=t.documents, benchmark=t.benchmark).collect()}
    assert {tuple(r) for r in t.qrels.collect()} == want == {(1, 0), (1, 1), (1, 6), (4, 6), (2, 5), (2, 9)}
    assert "MapInArrow" in t.qrels._jdf.queryExecution().executedPlan().toString()
    # a text cut by the end of its document, or between two documents, is not held
    assert sorted(r["doc_id"] for r in holding.holding(docs, benchmark).collect()) == [0, 0, 1, 5, 6, 9]
    assert holding.holding(docs, benchmark.where("item_id = 3")).count() == 0
    assert holding.holding(docs, spark.createDataFrame([("one",)], "text string")).count() == docs.count()


def test_every_document_that_holds_a_text_is_relevant(spark, tmp_path):
    """Texts of few words, cut inside a word, of signs only, of one byte or none: a pair is a document that holds the text, whatever its words."""
    from corpuscope.operators import holding
    from corpuscope.plans.bindings import Tables

    items = [(1, "one two three four five six"), (2, "two three"), (3, "ne two three four fi"), (4, "- - -"), (5, "ü"), (6, ""), (7, None), (8, "two three"), (9, "one two three four fi"), (None, "nothing else"), (10, "é")]
    texts = ["x one two three four five six y", "one two three four fifty", "bone two threes", "a - - - b", "Grüße", "", None, "two", " three", "nothing else two three", "x " * 3_000 + "one two three four five six", "two three two three"]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    for name, table in (("documents", docs), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        table.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    want = {(i, d) for i, item in items for d, text in enumerate(texts) if item is not None and text is not None and item in text}
    got = [tuple(r) for r in Tables(spark, str(tmp_path)).qrels.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # more items than travel at once, in groups; pieces of a buffer
    old = holding.MOST_ITEMS, holding.SCAN_BYTES
    holding.MOST_ITEMS, holding.SCAN_BYTES = 3, 16
    try:
        pairs = holding.held_pairs(docs, spark.createDataFrame(items, "item_id long, text string"))
        assert {tuple(r) for r in pairs.collect()} == want
        import pyarrow as pa

        finder = holding.Finder([b"two three", b"", b"two", b"one two three four five six"])
        assert {(int(r), int(n)) for r, n in zip(*finder.found(pa.array(["no", *texts]).slice(1)), strict=True)} == {
            (d, n) for n, t in enumerate(["two three", "", "two", "one two three four five six"]) for d, text in enumerate(texts) if text is not None and t in text}
    finally:
        holding.MOST_ITEMS, holding.SCAN_BYTES = old
    assert holding.held_pairs(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
