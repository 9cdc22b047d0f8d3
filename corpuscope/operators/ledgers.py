"""Run ledgers: transitions, closing rows, interrupted runs, pending questions, approvals, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.operators.listing import FINISHED, latest_steps
from corpuscope.operators.usage import running

# --- fixed values -----------------------------------------------------------------------------
SCHEMA_VERSION, HISTORY_DAYS, PENDING_HOURS = 1, 7, 24
CLOSING_STATUS = {"COMPLETED": "completed", "FAILED": "failed", "INTERRUPTED": "failed", "CANCELLED": "cancelled", "RESUMED": "completed"}
# ----------------------------------------------------------------------------------------------


def transitions(rows: DataFrame) -> DataFrame:
    """Add verdict (OK, AFTER_TERMINAL, BAD_SCHEMA) and state_version of the accepted ones to (generation_id, id, status, schema_version).

    The first terminal row of a run is a combinable minimum joined back.
    """
    known = F.col("schema_version") == SCHEMA_VERSION
    ending = rows.where(known & F.col("status").isin(*FINISHED)).groupBy("generation_id").agg(F.min("id").alias("_end"))
    joined = rows.join(ending, "generation_id", "left")
    verdict = F.when(~known, "BAD_SCHEMA").when(F.col("id") > F.col("_end"), "AFTER_TERMINAL").otherwise("OK")
    marked = joined.withColumn("verdict", verdict).drop("_end")
    ok = running(marked.where("verdict = 'OK'"), ["generation_id"], F.lit(1), "state_version", position=F.col("id"))
    return ok.unionByName(marked.where("verdict <> 'OK'").withColumn("state_version", F.lit(0).cast("long")))


def run_ledger(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """(generation_id, stage, status, open_steps): current stage and how many steps its latest rows leave running."""
    newest = latest_steps(steps)
    facts = newest.groupBy("generation_id").agg(F.max_by("stage", "id").alias("stage"), F.count_if(F.col("status") == "running").alias("open_steps"))
    return runs.select("generation_id", "status").join(facts, "generation_id", "left")


def closing_rows(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """(generation_id, step_id, stage, status): rows to append for steps that a finished run left running."""
    mapping = F.create_map(*[F.lit(x) for pair in CLOSING_STATUS.items() for x in pair])
    done = runs.where(F.col("status").isin(*FINISHED)).select("generation_id", mapping[F.col("status")].alias("_new"))
    return (latest_steps(steps).where("status = 'running'").join(done, "generation_id")
            .select("generation_id", "step_id", "stage", F.col("_new").alias("status")))


def interrupted_runs(runs: DataFrame, steps: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Runs still RUNNING without any step in the last ``minutes``: (generation_id, last_event, new_status)."""
    last = steps.groupBy("generation_id").agg(F.max("occurred_at").alias("last_event"))
    quiet = F.col("last_event") < now - F.make_dt_interval(mins=F.lit(minutes))
    return (runs.where("status = 'RUNNING'").select("generation_id").join(last, "generation_id", "left")
            .where(F.col("last_event").isNull() | quiet).withColumn("new_status", F.lit("INTERRUPTED")))


def pending_tasks(tasks: DataFrame, answers: DataFrame) -> DataFrame:
    """State of the newest waiting task per (user_id, conversation_id): RESUMED or EXPIRED by its first later answer, else WAITING.

    ``tasks``: user_id, conversation_id, task_id, created_at, expires_at. ``answers``: user_id, conversation_id, ts, answer.
    """
    key = ["user_id", "conversation_id"]
    newest = tasks.groupBy(*key).agg(F.max(F.struct("task_id", "created_at", "expires_at")).alias("_t")).select(*key, "_t.*")
    said = answers.where("trim(coalesce(answer, '')) <> ''").join(newest.select(*key, "created_at"), key).where(F.col("ts") >= F.col("created_at"))
    first = said.groupBy(*key).agg(F.min("ts").alias("answered_at"))
    state = F.when(F.col("answered_at").isNull(), "WAITING").when(F.col("expires_at") < F.col("answered_at"), "EXPIRED").otherwise("RESUMED")
    return newest.join(first, key, "left").withColumn("state", state)


def approvals(calls: DataFrame, decisions: DataFrame) -> DataFrame:
    """(decision_id, outcome): FORBIDDEN for others than the owner, APPLIED for the first, IDEMPOTENT for equal, CONFLICT for opposite ones."""
    owned = decisions.join(calls.select("call_id", F.col("user_id").alias("_owner")), "call_id")
    first = owned.where("user_id = _owner").groupBy("call_id").agg(F.min(F.struct("decision_id", "decision")).alias("_f"))
    j = owned.join(first, "call_id", "left")
    outcome = (F.when(F.col("user_id") != F.col("_owner"), "FORBIDDEN").when(F.col("decision_id") == F.col("_f.decision_id"), "APPLIED")
               .when(F.col("decision") == F.col("_f.decision"), "IDEMPOTENT").otherwise("CONFLICT"))
    return j.select("decision_id", "call_id", outcome.alias("outcome"))


def within_history(rows: DataFrame, key: str, ts: str, now: Column, days: int = HISTORY_DAYS) -> DataFrame:
    """Rows of keys whose last activity is at most ``days`` old."""
    live = rows.groupBy(key).agg(F.max(ts).alias("_last")).where(F.col("_last") >= now - F.make_dt_interval(days=F.lit(days))).select(key)
    return rows.join(live, key, "left_semi")
