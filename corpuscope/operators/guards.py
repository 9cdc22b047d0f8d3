"""Guards over ordered action rows: repeats, stagnation, cut-off in a batch, run budgets, turn history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.operators.access import first_rows
from corpuscope.operators.usage import running
from corpuscope.session import cut_lineage

# --- fixed values -----------------------------------------------------------------------------
REPEAT_WARNING, REPEAT_LIMIT, NO_PROGRESS_LIMIT, HISTORY_MESSAGES = 2, 3, 2, 20
MAX_MODEL_TURNS, MAX_TOOL_CALLS, MAX_PROMPT_TOKENS, MAX_COMPLETION_TOKENS, MAX_RUN_SECONDS = 4, 8, 24000, 8000, 120
# ----------------------------------------------------------------------------------------------


def repeated_actions(actions: DataFrame, *, warn: int = REPEAT_WARNING, limit: int = REPEAT_LIMIT) -> DataFrame:
    """Add occurrence (1..limit, higher ones read as the limit) and disposition ALLOW, WARN or BLOCK.

    Only the first ``limit - 1`` rows of a (run, fingerprint) need their exact number; the window keeps no more than those
    before its shuffle, all other rows are repeats beyond the limit and take their label from a join.
    """
    first = actions.withColumn("occurrence", F.row_number().over(
        Window.partitionBy("generation_id", "fingerprint").orderBy("id"))).where(F.col("occurrence") < limit)
    keyed = first.select("generation_id", "fingerprint", "id", "occurrence")
    joined = actions.join(keyed, ["generation_id", "fingerprint", "id"], "left").withColumn("occurrence", F.coalesce("occurrence", F.lit(limit)))
    label = F.when(F.col("occurrence") >= limit, "BLOCK").when(F.col("occurrence") >= warn, "WARN").otherwise("ALLOW")
    return joined.withColumn("disposition", label)


def stagnation(rounds: DataFrame, *, limit: int = NO_PROGRESS_LIMIT) -> DataFrame:
    """Add stagnant_rounds (equal signatures in a row before this one) and stop; blank signatures neither count nor reset.

    ``rounds``: generation_id, seq, signature. Built from running values in blocks, so no run has to fit into one task; each of the three reads the one before from the shared folder.
    """
    known = rounds.where("trim(coalesce(signature, '')) <> ''")
    here, run = F.struct("seq", "signature"), ["generation_id"]
    previous = cut_lineage(running(known, run, here, "_p", how="max", position=F.col("seq"), inclusive=False))
    numbered = cut_lineage(running(previous, run, F.lit(1), "_i", position=F.col("seq")))
    fresh = F.col("_p").isNull() | (F.col("_p.signature") != F.col("signature"))
    counted = running(numbered, run, F.when(fresh, F.col("_i")), "_since", how="max", position=F.col("seq"))
    return (counted.withColumn("stagnant_rounds", F.col("_i") - F.col("_since")).drop("_p", "_i", "_since")
            .withColumn("stop", F.col("stagnant_rounds") >= limit))


def batch_cutoff(calls: DataFrame) -> DataFrame:
    """Add outcome: calls after the first terminal or streamed one of their batch are CANCELLED_BY_RUNTIME.

    The first ending position is a combinable aggregate joined back; no window over a batch is needed.
    """
    ending = calls.where("terminal OR streamed").groupBy("batch_id").agg(F.min("pos").alias("_end"))
    joined = calls.join(ending, "batch_id", "left")
    return joined.withColumn("outcome", F.when(F.col("pos") > F.col("_end"), "CANCELLED_BY_RUNTIME").otherwise("EXECUTED")).drop("_end")


def recent_history(messages: DataFrame, n: int = HISTORY_MESSAGES) -> DataFrame:
    """The last ``n`` messages per conversation; the limit works before the shuffle as well."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("pos"))
    return messages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def budget_decisions(actions: DataFrame, *, turns: int = MAX_MODEL_TURNS, tools: int = MAX_TOOL_CALLS, prompt: int = MAX_PROMPT_TOKENS,
                     completion: int = MAX_COMPLETION_TOKENS, seconds: int = MAX_RUN_SECONDS) -> DataFrame:
    """Add decision (ALLOWED or the budget that is used up) to ordered actions of runs.

    ``actions``: generation_id, id, kind (MODEL, MODEL_WITH_TOOLS, TOOL), elapsed_ms, prompt_tokens, completion_tokens.
    Tokens are charged by an allowed model turn only and a denied action uses nothing. Budgets are only ever used up, so the
    fold has a closed form: without the token limit the turns of a run are its first ``turns - 1`` model actions in time and
    the first plain MODEL action after them; the token limit cuts this short list at the first turn that exceeds it; tool
    calls are the first ``tools`` in time before that cut. All of these are top-n limits and combinable minima.
    """
    timed = actions.where(F.col("elapsed_ms") < seconds * 1000)
    model = timed.where("kind <> 'TOOL'").select("generation_id", "id", "kind", F.greatest("prompt_tokens", F.lit(0)).alias("_p"),
                                                 F.greatest("completion_tokens", F.lit(0)).alias("_c"))
    early = first_rows(model, ["generation_id"], [F.asc("id")], max(0, turns - 1), "_n")
    full = early.groupBy("generation_id").agg(F.max("id").alias("_last"), F.count("*").alias("_k")).where(F.col("_k") == turns - 1)
    if turns == 1:
        late = first_rows(model.where("kind = 'MODEL'"), ["generation_id"], [F.asc("id")], 1, "_n")
    else:
        late = first_rows(model.join(full, "generation_id").where("id > _last AND kind = 'MODEL'"), ["generation_id"], [F.asc("id")], 1, "_n").drop("_last", "_k")
    turn_rows = early.unionByName(late)
    run = Window.partitionBy("generation_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    spent = turn_rows.withColumn("_sp", F.sum("_p").over(run)).withColumn("_sc", F.sum("_c").over(run))
    # the turn that uses up the tokens is itself allowed; everything after it is not
    cut = spent.where((F.col("_sp") >= prompt) | (F.col("_sc") >= completion)).groupBy("generation_id").agg(F.min("id").alias("_cut"))
    allowed_turns = turn_rows.join(cut, "generation_id", "left").where("_cut IS NULL OR id <= _cut")
    calls = timed.where("kind = 'TOOL'").select("generation_id", "id").join(cut, "generation_id", "left").where("_cut IS NULL OR id <= _cut")
    allowed_calls = first_rows(calls, ["generation_id"], [F.asc("id")], tools)
    allowed = allowed_turns.select("generation_id", "id").unionByName(allowed_calls.select("generation_id", "id")).withColumn("_ok", F.lit(True))
    joined = actions.join(cut, "generation_id", "left").join(allowed, ["generation_id", "id"], "left")
    decision = (F.when(F.col("elapsed_ms") >= seconds * 1000, "TIME_BUDGET_EXHAUSTED").when(F.col("id") > F.col("_cut"), "TOKEN_BUDGET_EXHAUSTED")
                .when(F.col("_ok"), "ALLOWED").when(F.col("kind") == "TOOL", "TOOL_BUDGET_EXHAUSTED").otherwise("ROUND_BUDGET_EXHAUSTED"))
    return joined.withColumn("decision", decision).drop("_cut", "_ok")
