"""Evaluation queries: retrieval metrics and gates, agent metrics, run health, traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.operators import access, evaluate as E, traces
from corpuscope.operators.postings import lexical_topk
from corpuscope.plans import fragments as sql
from corpuscope.plans.lists import LATEST
from corpuscope.plans.registry import query
from corpuscope.plans.retrieval import asked, index_of
from corpuscope.session import cut_lineage

_R4 = "floor(({v}) * 10000 + 0.5) / 10000"


def r4(v):
    return _R4.format(v=f"CAST({v} AS DOUBLE)")


CASES = f"""{sql.EFFECTIVE}, {sql.bm25('questions', 'docs', acl=True)}, top10 AS ({sql.topk('bm_scores', 10)}),
    tot AS (SELECT query_id, count(*) AS relevant FROM qrels GROUP BY 1),
    gain AS (SELECT query_id, count(*) AS hits, min(rank) AS best, sum(1.0::DOUBLE / log2(rank + 1)) AS dcg FROM top10 JOIN qrels USING (query_id, doc_id) GROUP BY 1),
    cases AS (SELECT query_id, relevant, coalesce(hits, 0) AS hits, {r4('coalesce(hits, 0)::DOUBLE / relevant')} AS recall_at_k, {r4('coalesce(1.0::DOUBLE / best, 0)')} AS reciprocal_rank,
      {r4('coalesce(dcg / list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 0)')} AS ndcg_at_k,
      relevant * 100 + query_id AS latency_ms FROM tot LEFT JOIN gain USING (query_id))"""


def cases(t):
    hits = lexical_topk(asked(t), index_of(t), 10, min_score=0.0)
    # the relevant documents are read twice, by the totals and by the hits
    found = E.retrieval_cases(hits, cut_lineage(t.qrels), 10)
    return found.withColumn("latency_ms", F.col("relevant") * 100 + F.col("query_id"))


@query("g12_retrieval_metrics", f"WITH RECURSIVE {CASES} SELECT query_id, relevant, hits, recall_at_k, reciprocal_rank, ndcg_at_k FROM cases")
def _metrics(t):
    return cases(t).drop("latency_ms")


REPORT = f"""{CASES}, report AS (SELECT count(*) AS queries, {r4('avg(recall_at_k)')} AS recall_at_k, {r4('avg(reciprocal_rank)')} AS mrr, {r4('avg(ndcg_at_k)')} AS ndcg_at_k,
    {r4('count(*) FILTER (hits = 0)::DOUBLE / count(*)')} AS zero_recall_rate, CAST(quantile_disc(latency_ms, 0.95) AS DOUBLE) AS p95_latency_ms FROM cases)"""


@query("g13_retrieval_report", f"WITH RECURSIVE {REPORT} SELECT * FROM report")
def _report(t):
    return E.retrieval_report(cases(t))


_GATES = " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS value, CAST({b} AS DOUBLE) AS threshold, {str(low).lower()} AS is_minimum FROM report"
                            for m, b, low in E.RETRIEVAL_GATES)


@query("g14_quality_gates", f"""WITH RECURSIVE {REPORT}, g AS ({_GATES}), c AS (SELECT *, CASE WHEN is_minimum THEN value >= threshold ELSE value <= threshold END AS passed FROM g)
    SELECT *, (SELECT bool_and(passed) FROM c) AS gate_passed FROM c""")
def _gate(t):
    return E.gate(E.retrieval_report(cases(t)))


@query("g15_binary_metrics", f"""WITH c AS (SELECT count(*) FILTER (expected_flag AND actual_flag) AS tp, count(*) FILTER (NOT expected_flag AND actual_flag) AS fp, count(*) FILTER (expected_flag AND NOT actual_flag) AS fn FROM attempt_labels),
    m AS (SELECT CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS r FROM c)
    SELECT {r4('p')} AS precision, {r4('r')} AS recall, {r4('CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END')} AS f1 FROM m""")
def _binary(t):
    return E.binary_metrics(t.attempt_labels, "expected_flag", "actual_flag")


@query("g16_macro_f1", f"""WITH l AS (SELECT lower(trim(expected_label)) AS e, lower(trim(actual_label)) AS a FROM attempt_labels), labels AS (SELECT e AS label FROM l WHERE e <> '' UNION SELECT a FROM l WHERE a <> ''),
    s AS (SELECT label, count(*) FILTER (e = label AND a = label) AS tp, count(*) FILTER (a = label) AS p, count(*) FILTER (e = label) AS x FROM labels, l GROUP BY label)
    SELECT count(*) AS labels, {r4('avg(CASE WHEN tp = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (p + x) END)')} AS macro_f1 FROM s""")
def _macro(t):
    return E.macro_f1(t.attempt_labels, "expected_label", "actual_label")


# word sets of a question and of the answer that follows it stand for expected and actual items
PAIRS = f"""pairs AS (SELECT q.conv_id, q.pos, list_distinct({sql.tokens('q.content')}) AS e, list_distinct({sql.tokens('a.content')}) AS a,
    {sql.tokens('q.content')} AS el, {sql.tokens('a.content')} AS al FROM messages q JOIN messages a ON a.conv_id = q.conv_id AND a.pos = q.pos + 1)"""


def pairs(t):
    from corpuscope.functions.text import tokens

    answer = t.messages.select("conv_id", (F.col("pos") - 1).alias("pos"), tokens("content").alias("al"))
    return t.messages.select("conv_id", "pos", tokens("content").alias("el")).join(answer, ["conv_id", "pos"])


@query("g17_set_f1", f"""WITH {PAIRS}, n AS (SELECT conv_id, pos, len(list_intersect(e, a)) AS m, len(a) AS p, len(e) AS x FROM pairs)
    SELECT conv_id, pos, {r4('CASE WHEN p = 0 AND x = 0 THEN 1 WHEN m = 0 THEN 0 ELSE 2.0::DOUBLE * m / (p + x) END')} AS f1 FROM n""")
def _set_f1(t):
    return pairs(t).select("conv_id", "pos", E.round4(E.set_f1(F.col("el"), F.col("al"))).alias("f1"))


@query("g18_claim_coverage", f"""WITH {PAIRS} SELECT conv_id, pos, {r4('CASE WHEN len(e) = 0 THEN 1 ELSE len(list_intersect(e, a))::DOUBLE / len(e) END')} AS coverage,
    {r4('CASE WHEN len(el) = 0 THEN CASE WHEN len(al) = 0 THEN 1 ELSE 0 END ELSE len(list_filter(el, lambda x: list_contains(a, x)))::DOUBLE / len(el) END')} AS argument_accuracy FROM pairs""")
def _coverage(t):
    def calls(words):
        return F.transform(words, lambda w: F.struct(w.alias("name"), F.lit("").alias("argumentsFingerprint")))

    return pairs(t).select("conv_id", "pos", E.round4(E.coverage(F.col("el"), F.col("al"))).alias("coverage"),
                           E.round4(E.tool_argument_accuracy(calls(F.col("el")), calls(F.col("al")))).alias("argument_accuracy"))


_EXPECTED = ("signup", "view", "click", "purchase")


def expected_path():
    return F.array(*[F.lit(s) for s in _EXPECTED])


_SUBSEQUENCES = ["".join(x for x, keep in zip("svcp", f"{bits:04b}") if keep == "1") for bits in range(1, 16)]
_LCS = "greatest(0, " + ", ".join(f"CASE WHEN path SIMILAR TO '.*{'.*'.join(s)}.*' THEN {len(s)} ELSE 0 END" for s in _SUBSEQUENCES) + ")"


@query("g19_trajectory_score", f"""WITH p AS (SELECT generation_id, count(*) AS n, string_agg(substr(stage, 1, 1), '' ORDER BY o) AS path FROM (SELECT generation_id, min(id) AS o, arg_max(stage, id) AS stage FROM steps GROUP BY generation_id, step_id) GROUP BY 1)
    SELECT generation_id, {r4(f"2.0::DOUBLE * {_LCS} / (n + 4)")} AS trajectory_score FROM p""")
def _trajectory(t):
    return traces.trajectories(t.steps).select("generation_id", E.round4(E.trajectory_score(expected_path(), F.col("trajectory"))).alias("trajectory_score"))


TRAJECTORY = """tr AS (SELECT generation_id, min(id) AS o, arg_max(stage, id) AS stage FROM steps GROUP BY generation_id, step_id),
    tl AS (SELECT *, lead(stage) OVER (PARTITION BY generation_id ORDER BY o) AS nxt FROM tr)"""


@query("g20_invalid_transitions", f"""WITH {TRAJECTORY} SELECT generation_id, {r4("CASE WHEN count(*) < 2 THEN 0 ELSE count(*) FILTER (nxt IS NOT NULL AND stage || '->' || nxt NOT IN ('signup->view', 'view->click', 'click->purchase'))::DOUBLE / (count(*) - 1) END")} AS invalid_rate FROM tl GROUP BY 1""")
def _invalid(t):
    return traces.trajectories(t.steps).select("generation_id", E.round4(E.invalid_transition_rate(expected_path(), F.col("trajectory"))).alias("invalid_rate"))


@query("g21_pass_metrics", f"""WITH c AS (SELECT case_id, arg_min(actual_flag, event_id) AS first, bool_and(actual_flag) AS every, count(*) AS n FROM attempt_labels GROUP BY 1)
    SELECT count(*) AS cases, {r4('count(*) FILTER (first)::DOUBLE / count(*)')} AS pass_at_1, {r4('count(*) FILTER (every)::DOUBLE / count(*)')} AS pass_power_k, max(n) AS observed_k FROM c""")
def _pass(t):
    return E.pass_metrics(t.attempt_labels.select("case_id", F.col("event_id").alias("attempt_index"), F.col("actual_flag").alias("passed")))


# per run: first and latest non-empty intent and status, conflicts, duplicate and write actions
SIGNALS = f"""{LATEST}, so AS (SELECT generation_id, step_id, min(id) AS o FROM steps GROUP BY 1, 2),
    sf AS (SELECT l.generation_id, arg_min(CASE WHEN stage IN ('view', 'click') THEN stage END, CASE WHEN stage IN ('view', 'click') THEN o END) AS intent,
      arg_max(CASE WHEN stage IN ('signup', 'error') THEN stage END, CASE WHEN stage IN ('signup', 'error') THEN o END) AS evidence_status, bool_or(k > 90) AS conflict, count(*) AS steps
      FROM latest l JOIN so USING (generation_id, step_id) GROUP BY 1),
    ca AS (SELECT generation_id, fingerprint, count(*) AS n, count(*) FILTER (status = 'REUSED') AS ru, count(*) FILTER (effect = 'WRITE') AS wr,
      count(*) FILTER (effect = 'WRITE' AND status = 'SUCCESS') AS dn FROM tool_calls GROUP BY 1, 2),
    cs AS (SELECT generation_id, sum(n) AS total_actions, sum(n - 1) AS duplicate_actions, sum(ru) AS reused_steps, sum(wr) AS write_actions, sum(greatest(dn - 1, 0)) AS duplicate_side_effects FROM ca GROUP BY 1),
    signals AS (SELECT r.generation_id, retry_of IS NOT NULL AS recovery_attempt, retry_of IS NOT NULL AND r.status = 'COMPLETED' AS recovered,
      (epoch_us(finished_at) - epoch_us(created_at)) // 1000 AS latency_ms, prompt_tokens, completion_tokens, coalesce(intent, '') AS intent, coalesce(evidence_status, '') AS evidence_status,
      coalesce(conflict, false) AS conflict, CAST(coalesce(total_actions, 0) AS BIGINT) AS total_actions, CAST(coalesce(duplicate_actions, 0) AS BIGINT) AS duplicate_actions,
      CAST(coalesce(reused_steps, 0) AS BIGINT) AS reused_steps, CAST(coalesce(write_actions, 0) AS BIGINT) AS write_actions,
      CAST(coalesce(duplicate_side_effects, 0) AS BIGINT) AS duplicate_side_effects, coalesce(steps, 0) AS steps
      FROM runs r LEFT JOIN sf USING (generation_id) LEFT JOIN cs USING (generation_id))"""


def signals(t):
    steps = t.steps.select("id", "generation_id", "step_id", "stage", F.when(F.col("stage").isin("view", "click"), F.col("stage")).otherwise("").alias("intent"),
                           F.when(F.col("stage").isin("signup", "error"), F.col("stage")).otherwise("").alias("evidence_status"), (F.col("k") > 90).alias("has_conflict"))
    return traces.trace_signals(t.runs, steps, t.tool_calls)


@query("g22_attempt_ratios", f"""WITH {SIGNALS} SELECT count(*) AS attempts, {r4('sum(duplicate_actions)::DOUBLE / sum(total_actions)')} AS duplicate_action_rate, {r4("count(*) FILTER (evidence_status = 'error')::DOUBLE / count(*)")} AS no_progress_rate,
    {r4('count(*) FILTER (recovered)::DOUBLE / count(*) FILTER (recovery_attempt)')} AS resume_success_rate, {r4('sum(duplicate_side_effects)::DOUBLE / greatest(sum(write_actions), sum(duplicate_side_effects))')} AS duplicate_side_effect_rate,
    CAST(quantile_disc(latency_ms, 0.95) AS BIGINT) AS p95_latency_ms, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens FROM signals""")
def _ratios(t):
    reason = F.when(F.col("evidence_status") == "error", " NO_PROGRESS").otherwise("ANSWERED")
    return E.ratio_metrics(signals(t).withColumn("terminal_reason", reason))


@query("g23_attempt_pass_rule", f"""WITH {SIGNALS}, {TRAJECTORY.replace('tl AS', 'unused_tl AS')}, w AS (SELECT generation_id, string_agg(substr(stage, 1, 1), '' ORDER BY o) AS path FROM tr GROUP BY 1),
    st AS (SELECT generation_id, bool_or(step_id = 's1') AS cited, bool_or(stage = 'view') AS claimed FROM steps GROUP BY 1), tc AS (SELECT generation_id, bool_or(tool = 'click' AND fingerprint = 'click:0') AS called FROM tool_calls GROUP BY 1)
    SELECT s.generation_id, w.path SIMILAR TO '.*v.*p.*' AND s.intent = 'view' AND NOT s.conflict AND s.total_actions > 0
      AND (r.user_id % 2 = 0 OR s.evidence_status = 'signup') AND (r.user_id % 3 = 0 OR r.status = 'COMPLETED') AND (r.user_id % 4 <> 1 OR coalesce(called, false))
      AND (r.user_id % 5 <> 2 OR cited) AND (r.user_id % 7 <> 3 OR claimed) AS passed
    FROM signals s JOIN w USING (generation_id) JOIN runs r USING (generation_id) JOIN st USING (generation_id) LEFT JOIN tc USING (generation_id)""")
def _pass_rule(t):
    # each side is taken from the run: its steps are its citations and claims, a run without an action asked back; some users expect more than others
    calls = t.tool_calls.groupBy("generation_id").agg(F.collect_list(F.struct(F.col("tool").alias("name"), "fingerprint")).alias("tools"))
    said = t.steps.groupBy("generation_id").agg(F.collect_set("step_id").alias("cited"), F.collect_set("stage").alias("claims"))
    joined = (signals(t).join(traces.trajectories(t.steps), "generation_id").join(t.runs.select("generation_id", "user_id", "status"), "generation_id")
              .join(said, "generation_id").join(calls, "generation_id", "left"))
    user = F.col("user_id")
    none, no_calls = F.array().cast("array<string>"), F.array().cast("array<struct<name:string,fingerprint:string>>")
    asks = lambda test, value, other: F.when(test, value).otherwise(other)
    rule = traces.passed(
        F.array(F.lit(" View"), F.lit("purchase ")), F.col("trajectory"), F.lit("VIEW"), F.col("intent"), F.lit(False), F.col("conflict"),
        expected_clarification=F.lit(False), clarification=F.col("total_actions") == 0,
        expected_evidence_status=asks(user % 2 == 0, F.lit(" "), F.lit("Signup ")), evidence_status=F.col("evidence_status"),
        expected_terminal_reason=asks(user % 3 == 0, F.lit(""), F.lit("answered")), terminal_reason=asks(F.col("status") == "COMPLETED", F.lit("ANSWERED"), F.lit("NO_PROGRESS")),
        expected_tools=asks(user % 4 == 1, F.array(F.struct(F.lit("Click").alias("name"), F.lit("click:0").alias("fingerprint"))), no_calls), tools=F.col("tools"),
        expected_citations=asks(user % 5 == 2, F.array(F.lit("s1")), none), citations=F.col("cited"),
        required_claims=asks(user % 7 == 3, F.array(F.lit("view")), none), supported_claims=F.col("claims"))
    return joined.select("generation_id", rule.alias("passed"))


@query("g24_attempt_validation", """SELECT case_id, attempt_index, CASE WHEN trim(case_id) = '' THEN 'BLANK_CASE' WHEN attempt_index < 1 THEN 'INDEX_BELOW_ONE' ELSE 'REPEATED' END AS reason FROM (
    SELECT CASE WHEN k = 7 THEN ' ' ELSE case_id END AS case_id, k % 9 AS attempt_index, count(*) AS n FROM attempt_labels GROUP BY 1, 2) WHERE trim(case_id) = '' OR attempt_index < 1 OR n > 1""")
def _validation(t):
    rows = t.attempt_labels.select(F.when(F.col("k") == 7, " ").otherwise(F.col("case_id")).alias("case_id"), (F.col("k") % 9).alias("attempt_index"))
    return E.invalid_attempts(rows)


@query("g25_trace_projection", f"WITH {SIGNALS} SELECT * FROM signals")
def _signals(t):
    return signals(t)


@query("e07_attempts_of_cases", """WITH g AS (SELECT user_id, generation_id, status, row_number() OVER (PARTITION BY user_id ORDER BY generation_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM runs)
    SELECT concat('case', CAST(user_id AS STRING)) AS case_id, n AS attempt_index, generation_id, status FROM g WHERE c >= 3 AND n <= 3""")
def _attempts(t):
    sampled = access.first_rows(t.runs, ["user_id"], [F.asc("generation_id")], traces.MAX_SAMPLES)
    ids = sampled.groupBy("user_id").agg(F.sort_array(F.collect_list("generation_id")).alias("generation_ids"))
    cases_ = ids.select(F.concat(F.lit("case"), F.col("user_id").cast("string")).alias("case_id"), "generation_ids")
    attempts, _ = traces.attempts_of_cases(cases_, t.runs.select("generation_id", "status"), 3)
    return attempts.select("case_id", "attempt_index", "generation_id", "status")


_STATUS = ", ".join(f"count(*) FILTER (r.status = '{s}') AS n_{s.lower()}" for s in traces.RUN_STATUSES)


def r2(v):
    return f"floor(CAST({v} AS DOUBLE) * 100 + 0.5) / 100"


@query("g10_run_health", f"""WITH {LATEST}, per AS (SELECT generation_id, count(*) AS st FROM latest GROUP BY 1), r AS (SELECT *, (epoch_us(finished_at) - epoch_us(created_at)) // 1000 AS ms FROM runs LEFT JOIN per USING (generation_id))
    SELECT user_id, count(*) AS runs, {_STATUS}, {r2("count(*) FILTER (r.status = 'COMPLETED')::DOUBLE / count(*)")} AS success_rate, CAST(floor(avg(ms) + 0.5) AS BIGINT) AS avg_latency_ms,
      CAST(quantile_disc(ms, 0.95) AS BIGINT) AS p95_latency_ms, {r2('sum(st)::DOUBLE / count(*)')} AS steps_per_run, count(retry_of) AS retries,
      {r2("CASE WHEN count(retry_of) = 0 THEN 0 ELSE count(retry_of) FILTER (r.status = 'COMPLETED')::DOUBLE / count(retry_of) END")} AS recovery_rate,
      CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM r GROUP BY user_id""")
def _health(t):
    return traces.run_health(t.runs, t.steps, by=["user_id"])


@query("g11_failure_stages", f"WITH {LATEST} SELECT stage, count(*) AS failures FROM latest WHERE status = 'failed' GROUP BY stage")
def _failures(t):
    return traces.failure_stages(t.steps)
