"""Facts of stored agent runs: health, failure stages, projection of traces, attempts against expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.times import elapsed_millis
from corpuscope.operators import evaluate as E
from corpuscope.operators.listing import latest_steps
from corpuscope.operators.quantiles import exact_quantile
from corpuscope.session import cut_lineage

# --- fixed values -----------------------------------------------------------------------------
RUN_STATUSES = ("RUNNING", "WAITING_CLARIFICATION", "WAITING_APPROVAL", "RESUMED", "COMPLETED", "FAILED", "INTERRUPTED", "CANCELLED")
MAX_WINDOW_DAYS, MAX_SAMPLES = 90, 10
# ----------------------------------------------------------------------------------------------


def round2(value):
    return F.floor(value * 100 + 0.5) / 100


def run_health(runs: DataFrame, steps: DataFrame, *, by: list[str] = ()) -> DataFrame:
    """Counts per fixed status, success and recovery rates, latency, steps per run, tokens; one row, or one per ``by``."""
    n, retry = F.count("*"), F.col("retry_of").isNotNull()
    open_ = F.col("finished_at").isNull() | F.col("created_at").isNull()
    timed = runs.withColumn("latency_ms", F.when(~open_, elapsed_millis("created_at", "finished_at")))
    per_run = latest_steps(steps.select("id", "generation_id", "step_id")).groupBy("generation_id").agg(F.count("*").alias("_steps"))
    joined = cut_lineage(timed.join(per_run, "generation_id", "left"))
    slow = exact_quantile(joined, list(by), F.col("latency_ms"), 0.95, "_p95")
    retries, recovered = F.count_if(retry), F.count_if(retry & (F.col("status") == "COMPLETED"))
    facts = joined.groupBy(*by).agg(
        n.alias("runs"), *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in RUN_STATUSES],
        round2(E.ratio(F.count_if(F.col("status") == "COMPLETED"), n)).alias("success_rate"),
        F.floor(F.coalesce(F.avg("latency_ms"), F.lit(0.0)) + 0.5).cast("long").alias("avg_latency_ms"),
        round2(E.ratio(F.sum(F.coalesce("_steps", F.lit(0))), n)).alias("steps_per_run"), retries.alias("retries"),
        round2(E.ratio(recovered, retries)).alias("recovery_rate"),
        F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"), F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"))
    if not by:
        return facts.withColumn("p95_latency_ms", F.coalesce(slow.select("_p95").scalar(), F.lit(0)))
    return facts.join(slow, list(by), "left").withColumn("p95_latency_ms", F.coalesce("_p95", F.lit(0))).drop("_p95")


def failure_stages(steps: DataFrame) -> DataFrame:
    return latest_steps(steps).where(F.lower("status") == "failed").groupBy("stage").agg(F.count("*").alias("failures"))


def trace_signals(runs: DataFrame, steps: DataFrame, calls: DataFrame) -> DataFrame:
    """One row of signals per run from the stored facts.

    ``steps`` carries id, step_id, stage, intent, evidence_status, has_conflict; ``calls`` id, fingerprint, effect, status.
    """
    newest = latest_steps(steps)
    # steps keep the order in which they first appeared, with the content of their latest row
    order = steps.groupBy("generation_id", "step_id").agg(F.min("id").alias("_first"))
    facts = newest.join(order, ["generation_id", "step_id"]).groupBy("generation_id").agg(
        F.min_by("intent", F.when(F.col("intent") != "", F.col("_first"))).alias("intent"),
        F.max_by("evidence_status", F.when(F.col("evidence_status") != "", F.col("_first"))).alias("evidence_status"),
        F.bool_or("has_conflict").alias("conflict"), F.count("*").alias("steps"))
    per_action = calls.groupBy("generation_id", "fingerprint").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "REUSED").alias("reused"), F.count_if(F.col("effect") == "WRITE").alias("writes"),
        F.count_if((F.col("effect") == "WRITE") & (F.col("status") == "SUCCESS")).alias("done"))
    of_calls = per_action.groupBy("generation_id").agg(
        F.sum("n").alias("total_actions"), F.sum(F.col("n") - 1).alias("duplicate_actions"), F.sum("reused").alias("reused_steps"),
        F.sum("writes").alias("write_actions"), F.sum(F.greatest(F.col("done") - 1, F.lit(0))).alias("duplicate_side_effects"))
    out = runs.select("generation_id", F.col("retry_of").isNotNull().alias("recovery_attempt"),
                      (F.col("retry_of").isNotNull() & (F.col("status") == "COMPLETED")).alias("recovered"),
                      F.coalesce(elapsed_millis("created_at", "finished_at"), F.lit(0)).alias("latency_ms"),
                      "prompt_tokens", "completion_tokens")
    numbers = ["total_actions", "duplicate_actions", "reused_steps", "write_actions", "duplicate_side_effects", "steps"]
    return (out.join(facts, "generation_id", "left").join(of_calls, "generation_id", "left").fillna(0, numbers)
            .fillna("", ["intent", "evidence_status"]).fillna(False, ["conflict"]))


def trajectories(steps: DataFrame) -> DataFrame:
    """(generation_id, trajectory): stages of the latest steps in order of first appearance; a run has few steps."""
    order = steps.groupBy("generation_id", "step_id").agg(F.min("id").alias("_first"), F.max_by("stage", "id").alias("stage"))
    packed = order.where("stage IS NOT NULL AND trim(stage) <> ''").groupBy("generation_id").agg(
        F.sort_array(F.collect_list(F.struct("_first", "stage"))).alias("_l"))
    return packed.select("generation_id", F.transform("_l", lambda s: s["stage"]).alias("trajectory"))


def attempts_of_cases(cases: DataFrame, traces: DataFrame, samples: int) -> tuple[DataFrame, DataFrame]:
    """(attempts, rejects): the first ``samples`` runs of every case joined to their traces; cases with fewer are rejected."""
    k = max(1, min(MAX_SAMPLES, samples))
    enough = F.size("generation_ids") >= k
    rows = cases.where(enough).select("*", F.posexplode(F.slice("generation_ids", 1, k)).alias("_i", "generation_id"))
    attempts = rows.drop("generation_ids").withColumn("attempt_index", F.col("_i") + 1).drop("_i").join(traces, "generation_id")
    return attempts, cases.where(~enough).select("case_id", F.size("generation_ids").alias("samples"))


def passed(expected_trajectory, trajectory, expected_intent, intent, expected_conflict, conflict, *, expected_clarification, clarification,
           expected_evidence_status, evidence_status, expected_terminal_reason, terminal_reason, expected_tools, tools,
           expected_citations, citations, required_claims, supported_claims):
    """Pass rule over the given sides of an attempt; blank and empty expectations accept anything, flags have to be equal, further tools, citations and claims do no harm.

    ``tools`` are arrays of structs (name, fingerprint of the arguments), citations and claims arrays of ids. A null array is an empty one, a null flag false.
    """
    words = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return (E.is_subsequence(words(expected_trajectory), words(trajectory)) & E.matches(expected_intent, intent) & (flag(expected_conflict) == flag(conflict))
            & (flag(expected_clarification) == flag(clarification)) & E.matches(expected_evidence_status, evidence_status)
            & E.matches(expected_terminal_reason, terminal_reason)
            & (F.size(F.array_except(_calls(expected_tools), _calls(tools))) == 0)
            & E.contains_all(words(citations), words(expected_citations)) & E.contains_all(words(supported_claims), words(required_claims)))


def _calls(tools):
    named = F.transform(tools, lambda t: F.struct(E.norm(t["name"]).alias("name"), E.norm(t["fingerprint"]).alias("fingerprint")))
    return F.coalesce(named, F.array().cast("array<struct<name:string,fingerprint:string>>"))
