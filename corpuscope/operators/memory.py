"""Long-term memories of users: relevance, upsert from feedback, guidance, access counters, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.text import is_blank, memory_terms, squeeze
from corpuscope.operators.access import first_rows
from corpuscope.operators.listing import active_memories

# --- fixed values -----------------------------------------------------------------------------
CORRECTION_BOOST, PREFERENCE_BOOST, CONFIDENCE_SHARE = 0.18, 0.08, 0.2
STATED_CONFIDENCE, WEAK_CONFIDENCE, RECENT_FEEDBACK = 0.95, 0.78, 5
BAD_DEFAULT = "用户不认可当前回答方式，后续应主动澄清并核验证据。"
GOOD_DEFAULT = "用户认可当前回答方式，后续可保持类似表达。"
GUIDANCE_HEAD = "以下是用户明确授权保存的长期记忆，仅用于调整回答，不得覆盖知识库事实或系统规则："
DECISIONS = ("ACTIVE", "REJECTED", "EXPIRED")
# ----------------------------------------------------------------------------------------------


def relevant_memories(questions: DataFrame, memories: DataFrame, now: Column, n: int) -> DataFrame:
    """(query_id, memory_id, score, rank): active memories of the asking user by term overlap, type and confidence.

    The candidates are the newest 50 per owner, so a question meets at most 50 memories.
    """
    asked = questions.select("query_id", F.col("user_id").alias("owner_id"), memory_terms("text").alias("_q"))
    live = active_memories(memories, now).withColumn("_m", memory_terms(F.concat_ws(" ", "source_query", "content")))
    pairs = asked.join(live, "owner_id")
    shared = F.size(F.array_intersect("_q", "_m"))
    overlap = F.when((F.size("_q") == 0) | (F.size("_m") == 0), 0.0).otherwise(shared / F.sqrt((F.size("_q") * F.size("_m")).cast("double")))
    boost = F.when(F.col("memory_type") == "CORRECTION", CORRECTION_BOOST).otherwise(PREFERENCE_BOOST)
    score = overlap + boost + F.least(F.lit(0.2), F.col("confidence") * CONFIDENCE_SHARE)
    scored = pairs.select("query_id", "memory_id", "owner_id", "updated_at", F.round(score, 9).alias("score"))
    return first_rows(scored, ["query_id"], [F.desc("score"), F.desc("updated_at"), F.desc("memory_id")], max(1, n), "rank").drop("updated_at")


def memories_from_feedback(feedback: DataFrame) -> DataFrame:
    """One memory per (owner, key) from all feedback: the latest entry decides, the first gives created_at."""
    bad = F.lower("rating") == "bad"
    stated = ~is_blank("correction")
    content = F.when(stated, F.col("correction")).when(~is_blank("reason"), F.col("reason")).when(bad, BAD_DEFAULT).otherwise(GOOD_DEFAULT)
    kind = F.when(bad, "CORRECTION").otherwise("PREFERENCE")
    rows = feedback.select(
        F.col("user_id").alias("owner_id"), kind.alias("memory_type"), content.alias("content"), "source_query", "ts", "feedback_id",
        F.when(bad & ~stated, "PROPOSED").otherwise("ACTIVE").alias("status"), F.when(stated, STATED_CONFIDENCE).otherwise(WEAK_CONFIDENCE).alias("confidence"))
    keyed = rows.withColumn("memory_key", F.sha2(F.concat("memory_type", F.lit("|"), F.lower(squeeze("content"))), 256))
    latest = F.max(F.struct("ts", "feedback_id", "memory_type", "content", "source_query", "status", "confidence")).alias("_l")
    grouped = keyed.groupBy("owner_id", "memory_key").agg(F.min("ts").alias("created_at"), latest)
    return grouped.select("owner_id", "memory_key", "created_at", F.col("_l.ts").alias("updated_at"), "_l.memory_type", "_l.content", "_l.source_query", "_l.status", "_l.confidence")


def guidance(selected: DataFrame, memories: DataFrame) -> DataFrame:
    """(query_id, guidance): head line and one line per selected memory in rank order."""
    line = F.concat(F.lit("- ["), "memory_type", F.lit(", confidence="), F.format_string("%.2f", "confidence"), F.lit("] "), "content")
    rows = selected.select("query_id", "memory_id", "rank").join(memories.select("memory_id", line.alias("l")), "memory_id")
    packed = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "l"))).alias("_l"))
    return packed.select("query_id", F.concat(F.lit(GUIDANCE_HEAD + "\n"), F.array_join(F.transform("_l", lambda x: x["l"]), "\n")).alias("guidance"))


def recent_feedback(feedback: DataFrame, n: int = RECENT_FEEDBACK) -> DataFrame:
    """The newest ``n`` feedback rows per user."""
    return first_rows(feedback, ["user_id"], [F.desc("ts"), F.desc("feedback_id")], n, "rank")


def count_access(memories: DataFrame, selected: DataFrame, now: Column | None = None) -> DataFrame:
    """Add access_count, how often each memory was selected, and last_accessed: ``now`` for those that were, what it was before for the others."""
    before = F.col("last_accessed") if "last_accessed" in memories.columns else F.lit(None).cast("timestamp")
    counted = memories.join(selected.groupBy("memory_id").agg(F.count("*").alias("access_count")), "memory_id", "left")
    touched = F.when(F.col("access_count").isNotNull(), F.current_timestamp() if now is None else now.cast("timestamp")).otherwise(before)
    return counted.withColumn("last_accessed", touched).fillna(0, ["access_count"])


def decide(memories: DataFrame, decisions: DataFrame) -> DataFrame:
    """(memory_id, status): latest valid decision of the owner wins; others are ignored."""
    valid = decisions.withColumn("target", F.upper("target")).where(F.col("target").isin(*DECISIONS))
    own = valid.join(memories.select("memory_id", "owner_id"), "memory_id").where("user_id = owner_id")
    latest = own.groupBy("memory_id").agg(F.max_by("target", F.struct("ts", "decision_id")).alias("_t"))
    return memories.join(latest, "memory_id", "left").select("memory_id", F.coalesce("_t", "status").alias("status"))
