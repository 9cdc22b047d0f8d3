"""Scores of retrieval runs and agent attempts, reports and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.text import jtrim
from corpuscope.operators.quantiles import exact_quantile
from corpuscope.session import cut_lineage

# --- fixed values: default gates (metric, bound, is_minimum) --------------------------------------
RETRIEVAL_GATES = (
    ("recall_at_k", 0.75, True), ("mrr", 0.60, True), ("ndcg_at_k", 0.65, True),
    ("zero_recall_rate", 0.15, False), ("p95_latency_ms", 3000.0, False),
)
AGENT_GATES = (
    ("clarification_f1", 0.80, True), ("intent_macro_f1", 0.80, True), ("evidence_status_macro_f1", 0.80, True),
    ("conflict_detection_f1", 0.80, True), ("trajectory_score", 0.80, True), ("invalid_transition_rate", 0.05, False),
    ("tool_selection_f1", 0.80, True), ("tool_argument_accuracy", 0.80, True), ("citation_f1", 0.80, True),
    ("claim_coverage", 0.80, True), ("duplicate_action_rate", 0.05, False), ("terminal_reason_accuracy", 0.90, True),
    ("resume_success_rate", 0.80, True), ("duplicate_side_effect_rate", 0.0, False), ("pass_power_k", 0.70, True),
)
# ----------------------------------------------------------------------------------------------


def round4(value: Column) -> Column:
    return F.floor(value * 10000 + 0.5) / 10000


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def norm(value: Column) -> Column:
    return F.lower(jtrim(F.coalesce(value, F.lit(""))))


def f1(matched: Column, predicted: Column, expected: Column) -> Column:
    """Harmonic mean of precision and recall; 1 when nothing was expected or predicted."""
    both_empty = (predicted == 0) & (expected == 0)
    return F.when(both_empty, 1.0).when(matched == 0, 0.0).otherwise(2.0 * matched / (predicted + expected))


def norm_set(values: Column) -> Column:
    return F.array_distinct(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: norm(v)))


def set_f1(expected: Column, actual: Column) -> Column:
    e, a = norm_set(expected), norm_set(actual)
    return f1(F.size(F.array_intersect(e, a)), F.size(a), F.size(e))


def coverage(required: Column, supported: Column) -> Column:
    r = norm_set(required)
    return F.when(F.size(r) == 0, 1.0).otherwise(F.size(F.array_intersect(r, norm_set(supported))) / F.size(r))


def _call_key(call: Column) -> Column:
    return F.concat(norm(call["name"]), F.lit("\n"), norm(call["argumentsFingerprint"]))


def tool_argument_accuracy(expected: Column, actual: Column) -> Column:
    """Share of expected calls found with the same name and arguments; repeats count each time."""
    keys = F.transform(actual, _call_key)
    hits = F.size(F.filter(expected, lambda c: F.array_contains(keys, _call_key(c))))
    return F.when(F.size(expected) == 0, F.when(F.size(actual) == 0, 1.0).otherwise(0.0)).otherwise(hits / F.size(expected))


def lcs_length(expected: Column, actual: Column) -> Column:
    """Longest common subsequence: one fold per table row over arrays, the rows of the recurrence as state."""
    left, right = F.transform(expected, lambda v: norm(v)), F.transform(actual, lambda v: norm(v))
    zeros = F.array_repeat(F.lit(0), F.size(right) + 1)

    def next_row(row, value):
        def cell(acc, j):
            up, diagonal = F.get(row, j), F.get(row, j - 1)
            best = F.when(F.get(right, j - 1) == value, diagonal + 1).otherwise(F.greatest(up, F.element_at(acc, -1)))
            return F.concat(acc, F.array(best))

        steps = F.when(F.size(right) > 0, F.sequence(F.lit(1), F.size(right))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.array(F.lit(0)), cell)

    return F.aggregate(left, zeros, next_row, lambda row: F.element_at(row, -1))


def trajectory_score(expected: Column, actual: Column) -> Column:
    return f1(lcs_length(expected, actual), F.size(actual), F.size(expected))


def _transitions(steps: Column) -> Column:
    named = F.transform(steps, lambda v: norm(v))
    pairs = F.zip_with(F.slice(named, 1, F.greatest(F.size(named) - 1, F.lit(0))), F.slice(named, 2, F.greatest(F.size(named) - 1, F.lit(0))),
                       lambda a, b: F.concat(a, F.lit("->"), b))
    return F.when(F.size(named) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def invalid_transition_rate(expected: Column, actual: Column) -> Column:
    allowed, taken = _transitions(expected), _transitions(actual)
    wrong = F.size(F.filter(taken, lambda p: ~F.array_contains(allowed, p)))
    return F.when(F.size(actual) < 2, 0.0).otherwise(wrong / (F.size(actual) - 1))


def matches(expected: Column, actual: Column) -> Column:
    """A blank expectation accepts anything."""
    return (norm(expected) == "") | (norm(expected) == norm(actual))


def is_subsequence(expected: Column, actual: Column) -> Column:
    """True when the expected steps occur in order; a blank step accepts any."""
    def move(cursor, value):
        here = F.get(expected, cursor)
        return F.when((cursor < F.size(expected)) & matches(here, value), cursor + 1).otherwise(cursor)

    return F.aggregate(actual, F.lit(0), move) == F.size(expected)


def contains_all(actual: Column, expected: Column) -> Column:
    return F.size(F.array_except(norm_set(expected), norm_set(actual))) == 0


def retrieval_cases(hits: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, relevant, hits, recall_at_k, reciprocal_rank, ndcg_at_k) for every judged query.

    ``hits`` is (query_id, doc_id, rank); a document listed twice counts at its first rank.
    """
    judged = qrels.select("query_id", "doc_id").distinct()
    totals = judged.groupBy("query_id").agg(F.count("*").alias("relevant"))
    first = hits.where(F.col("rank") <= k).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    found = first.join(judged, ["query_id", "doc_id"])
    gains = found.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("_best"),
                                          F.sum(1.0 / F.log2(F.col("rank") + 1)).alias("_dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1))
    return totals.join(gains, "query_id", "left").select(
        "query_id", "relevant", F.coalesce("hits", F.lit(0)).alias("hits"),
        round4(F.coalesce("hits", F.lit(0)) / F.col("relevant")).alias("recall_at_k"),
        round4(F.coalesce(1.0 / F.col("_best"), F.lit(0.0))).alias("reciprocal_rank"),
        round4(F.coalesce(F.col("_dcg") / ideal, F.lit(0.0))).alias("ndcg_at_k"))


def retrieval_report(cases: DataFrame) -> DataFrame:
    """One row of means over all judged queries. ``cases`` may carry latency_ms."""
    aggs = [F.count("*").alias("queries"), round4(F.avg("recall_at_k")).alias("recall_at_k"), round4(F.avg("reciprocal_rank")).alias("mrr"),
            round4(F.avg("ndcg_at_k")).alias("ndcg_at_k"), round4(F.count_if(F.col("hits") == 0) / F.count("*")).alias("zero_recall_rate")]
    if "latency_ms" not in cases.columns:
        return cases.agg(*aggs)
    cases = cut_lineage(cases)
    return cases.agg(*aggs).withColumn("p95_latency_ms", exact_quantile(cases, [], F.col("latency_ms"), 0.95, "p").select(F.col("p").cast("double")).scalar())


def gate(report: DataFrame, gates=RETRIEVAL_GATES) -> DataFrame:
    """(metric, value, threshold, is_minimum, passed, gate_passed): every threshold against the one-row report."""
    present = [g for g in gates if g[0] in report.columns]
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(b)).alias("threshold"),
                                        F.lit(low).alias("is_minimum")) for m, b, low in present])).alias("g")
    passed = F.when(F.col("is_minimum"), F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    checked = report.select(rows).select("g.*").withColumn("passed", passed)
    everything = F.bool_and("passed")
    return checked.withColumn("gate_passed", checked.select(everything).scalar())


def binary_metrics(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """(precision, recall, f1); an empty denominator gives 1."""
    tp, fp, fn = (F.count_if(F.col(expected) & F.col(actual)), F.count_if(~F.col(expected) & F.col(actual)), F.count_if(F.col(expected) & ~F.col(actual)))
    counts = df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    precision = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    recall = F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    harmonic = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return counts.select(round4(precision).alias("precision"), round4(recall).alias("recall"), round4(harmonic).alias("f1"))


def macro_f1(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """(labels, macro_f1) over labels seen on either side; 1 when there is none."""
    sides = F.array(F.struct(norm(F.col(expected)).alias("label"), F.lit(1).alias("e"), F.lit(0).alias("a")),
                    F.struct(norm(F.col(actual)).alias("label"), F.lit(0).alias("e"), F.lit(1).alias("a")))
    same = norm(F.col(expected)) == norm(F.col(actual))
    merged = F.when(same, F.array(F.struct(norm(F.col(expected)).alias("label"), F.lit(1).alias("e"), F.lit(1).alias("a")))).otherwise(sides)
    per_label = (df.select(F.explode(merged).alias("s")).select("s.*").where("label <> ''").groupBy("label")
                 .agg(F.sum(F.col("e") * F.col("a")).alias("tp"), F.sum("a").alias("p"), F.sum("e").alias("x")))
    return per_label.agg(F.count("*").alias("labels"), round4(F.coalesce(F.avg(f1(F.col("tp"), F.col("p"), F.col("x"))), F.lit(1.0))).alias("macro_f1"))


def pass_metrics(attempts: DataFrame) -> DataFrame:
    """(cases, pass_at_1, pass_power_k, observed_k): first attempt passed, all attempts passed."""
    per_case = attempts.groupBy("case_id").agg(F.min_by("passed", "attempt_index").alias("first"), F.bool_and("passed").alias("every"), F.count("*").alias("n"))
    return per_case.agg(F.count("*").alias("cases"), round4(F.count_if("first") / F.count("*")).alias("pass_at_1"),
                        round4(F.count_if("every") / F.count("*")).alias("pass_power_k"), F.max("n").alias("observed_k"))


def invalid_attempts(attempts: DataFrame) -> DataFrame:
    """(case_id, attempt_index, reason): blank case, index below 1, or a repeated (case, attempt)."""
    grouped = attempts.groupBy("case_id", "attempt_index").agg(F.count("*").alias("n"))
    reason = (F.when(norm(F.col("case_id")) == "", "BLANK_CASE").when(F.col("attempt_index") < 1, "INDEX_BELOW_ONE").when(F.col("n") > 1, "REPEATED"))
    return grouped.select("case_id", "attempt_index", reason.alias("reason")).where("reason IS NOT NULL")


def attempt_scores(attempts: DataFrame) -> DataFrame:
    """One score row per attempt in the golden-set schema."""
    c = F.col
    names = lambda calls: F.transform(calls, lambda x: x["name"])
    return attempts.select(
        "caseId", "attemptIndex", round4(set_f1(c("expectedClarificationSlots"), c("actualClarificationSlots"))).alias("slot_f1"),
        round4(trajectory_score(c("expectedTrajectory"), c("actualTrajectory"))).alias("trajectory_score"),
        round4(invalid_transition_rate(c("expectedTrajectory"), c("actualTrajectory"))).alias("invalid_transition_rate"),
        round4(set_f1(names(c("expectedTools")), names(c("actualTools")))).alias("tool_selection_f1"),
        round4(tool_argument_accuracy(c("expectedTools"), c("actualTools"))).alias("tool_argument_accuracy"),
        round4(set_f1(c("expectedCitationIds"), c("actualCitationIds"))).alias("citation_f1"),
        round4(coverage(c("requiredClaimIds"), c("supportedClaimIds"))).alias("claim_coverage"),
        (norm(c("expectedTerminalReason")) == norm(c("actualTerminalReason"))).alias("terminal_matched"), "passed")


def ratio_metrics(attempts: DataFrame) -> DataFrame:
    """Ratios over all attempts (duplicate_actions, total_actions, terminal_reason, recovery_attempt, recovered,
    duplicate_side_effects, write_actions, latency_ms, prompt_tokens, completion_tokens)."""
    n = F.count("*")
    dup, total = F.sum(F.greatest(F.lit(0), "duplicate_actions")), F.sum(F.greatest(F.lit(0), "total_actions"))
    side, writes = F.sum(F.greatest(F.lit(0), "duplicate_side_effects")), F.sum(F.greatest(F.lit(0), "write_actions"))
    tries = F.count_if("recovery_attempt")
    won = F.count_if(F.col("recovery_attempt") & F.col("recovered"))
    attempts = cut_lineage(attempts)
    slow = exact_quantile(attempts, [], F.greatest(F.lit(0).cast("long"), "latency_ms"), 0.95, "p").select("p")
    return attempts.agg(
        n.alias("attempts"), round4(ratio(dup, total)).alias("duplicate_action_rate"),
        round4(F.count_if(norm(F.col("terminal_reason")) == "no_progress") / n).alias("no_progress_rate"),
        round4(F.when(tries == 0, 1.0).otherwise(won / tries)).alias("resume_success_rate"),
        round4(ratio(side, F.greatest(writes, side))).alias("duplicate_side_effect_rate"),
        F.sum(F.greatest(F.lit(0), "prompt_tokens") + F.greatest(F.lit(0), "completion_tokens")).alias("total_tokens")).withColumn("p95_latency_ms", slow.scalar())


def agent_report(attempts: DataFrame) -> DataFrame:
    """One-row report over attempts in the golden-set schema, with every metric the gates need."""
    scored = attempt_scores(attempts)
    means = scored.agg(*[round4(F.avg(m)).alias(m) for m in ("slot_f1", "trajectory_score", "invalid_transition_rate", "tool_selection_f1",
                                                             "tool_argument_accuracy", "citation_f1", "claim_coverage")],
                       round4(F.avg(F.col("terminal_matched").cast("double"))).alias("terminal_reason_accuracy"))
    s = attempts.select(
        F.col("caseId").alias("case_id"), F.col("attemptIndex").alias("attempt_index"), "passed", "expectedClarification", "actualClarification",
        F.col("signals.expectedConflict").alias("expected_conflict"), F.col("signals.actualConflict").alias("actual_conflict"),
        F.col("signals.expectedIntent").alias("expected_intent"), F.col("signals.actualIntent").alias("actual_intent"),
        F.col("signals.expectedEvidenceStatus").alias("expected_status"), F.col("signals.actualEvidenceStatus").alias("actual_status"),
        F.col("duplicateActionCount").alias("duplicate_actions"), F.col("totalActionCount").alias("total_actions"),
        F.col("actualTerminalReason").alias("terminal_reason"), F.col("signals.recoveryAttempt").alias("recovery_attempt"),
        F.col("signals.recoverySucceeded").alias("recovered"), F.col("signals.duplicateSideEffectCount").alias("duplicate_side_effects"),
        F.col("signals.writeActionCount").alias("write_actions"), F.col("signals.latencyMs").alias("latency_ms"),
        F.col("signals.promptTokens").alias("prompt_tokens"), F.col("signals.completionTokens").alias("completion_tokens"))
    single = {
        "clarification_f1": binary_metrics(s, "expectedClarification", "actualClarification").select("f1"),
        "conflict_detection_f1": binary_metrics(s, "expected_conflict", "actual_conflict").select("f1"),
        "intent_macro_f1": macro_f1(s, "expected_intent", "actual_intent").select("macro_f1"),
        "evidence_status_macro_f1": macro_f1(s, "expected_status", "actual_status").select("macro_f1"),
    }
    for name in ("pass_at_1", "pass_power_k", "observed_k"):
        single[name] = pass_metrics(s).select(name)
    ratios = ratio_metrics(s)
    for name in ratios.columns:
        single[name] = ratios.select(name)
    return means.select("*", *[one.scalar().alias(name) for name, one in single.items()])
