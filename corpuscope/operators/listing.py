"""Lists, pages, look-ups and latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions.text import TITLE_LENGTH, audit_message, limit_text
from corpuscope.operators.access import first_rows, split_tags
from corpuscope.operators.closure import chain_starts

# --- fixed values: caps, states and the title of a new session ----------------------------------
MEMORY_CANDIDATES, RECENT_RUNS = 50, 50
RECOVERABLE = ("FAILED", "INTERRUPTED", "CANCELLED", "WAITING_APPROVAL")
FINISHED = ("COMPLETED", "FAILED", "CANCELLED", "INTERRUPTED", "RESUMED")
DEFAULT_TITLE = "新对话"
CLOSED_DETAIL = "Agent 运行终止，当前步骤已安全关闭"
# ------------------------------------------------------------------------------------------------


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) in a total order, with total rows and pages. A deep page costs a sort up to it."""
    total = df.select(F.count("*")).scalar()
    rows = df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)
    return rows.withColumn("total", total).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))


def history(messages: DataFrame, start, end, *, user: int | None = None, ts: str = "ts") -> DataFrame:
    """Rows of one user or all inside a closed time range; the filter reaches the scan."""
    out = messages.where(F.col(ts).between(F.lit(start), F.lit(end)))
    return out if user is None else out.where(F.col("user_id") == user)


def active_memories(memories: DataFrame, now: Column, n: int = MEMORY_CANDIDATES) -> DataFrame:
    """Active, unexpired memories, the newest ``n`` per owner."""
    live = memories.where((F.col("status") == "ACTIVE") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    return first_rows(live, ["owner_id"], [F.desc("updated_at"), F.desc("memory_id")], n)


def latest_steps(steps: DataFrame) -> DataFrame:
    """Latest row per (generation_id, step_id); combines before the shuffle, so a hot run stays cheap."""
    others = [c for c in steps.columns if c not in ("generation_id", "step_id", "id")]
    newest = steps.groupBy("generation_id", "step_id").agg(F.max(F.struct("id", *others)).alias("_r"))
    return newest.select("generation_id", "step_id", "_r.*")


def step_view(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """Latest steps as shown to users: a step still 'running' in a run that is not reads failed or cancelled, with a closing note for its ``detail``;
    what a failed step says is shown as an audit message."""
    ended = runs.select("generation_id", F.col("status").alias("run_status"))
    dangling = (F.lower("status") == "running") & (F.upper("run_status") != "RUNNING")
    shown = F.when(dangling, F.when(F.upper("run_status") == "CANCELLED", "cancelled").otherwise("failed")).otherwise(F.col("status"))
    out = latest_steps(steps).join(ended, "generation_id").withColumn("_dangling", dangling).withColumn("status", shown)
    if "detail" in steps.columns:
        raw = F.when(F.col("_dangling"), CLOSED_DETAIL).otherwise(F.col("detail"))
        out = out.withColumn("detail", F.when(F.lower("status") == "failed", audit_message(raw)).otherwise(raw))
    return out.drop("_dangling")


def recoverable_runs(runs: DataFrame, steps: DataFrame, n: int = RECENT_RUNS) -> DataFrame:
    """Recoverable runs among the first ``n`` of every conversation, with their steps as shown."""
    early = first_rows(runs, ["user_id", "conversation_id"], [F.asc("created_at"), F.asc("generation_id")], n)
    wanted = early.where(F.col("status").isin(*RECOVERABLE)).select("generation_id", "user_id", "conversation_id", F.col("status"))
    shown = step_view(steps.join(wanted.select("generation_id"), "generation_id", "left_semi"), wanted.select("generation_id", "status"))
    columns = ["generation_id", "step_id", "stage", F.col("status").alias("step_state"), *(["detail"] if "detail" in steps.columns else [])]
    return wanted.withColumnRenamed("status", "run_state").join(shown.select(*columns), "generation_id", "left")


def rate_settings(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """Default limits overlaid by stored rows, field by field; (config_key, max_requests, window_seconds)."""
    over = stored.select("config_key", F.col("max_requests").alias("_m"), F.col("window_seconds").alias("_w"))
    return defaults.join(over, "config_key", "left").select(
        "config_key", F.coalesce("_m", "max_requests").alias("max_requests"), F.coalesce("_w", "window_seconds").alias("window_seconds"))


def sessions(messages: DataFrame) -> DataFrame:
    """(conv_id, title, last_pos): the first question, cut to the title length, replaces the default title."""
    asked = F.struct("pos", "content")
    rows = messages.groupBy("conv_id", "user_id").agg(F.min(F.when(F.col("role") == "user", asked)).alias("_q"), F.max("pos").alias("last_pos"))
    return rows.select("conv_id", "user_id", F.coalesce(limit_text("_q.content", TITLE_LENGTH, ""), F.lit(DEFAULT_TITLE)).alias("title"), "last_pos")


def names_for(ledger: DataFrame, users: DataFrame, default: str = "Unknown User") -> DataFrame:
    people = users.select("user_id", "username")
    return ledger.join(people, "user_id", "left").withColumn("username", F.coalesce("username", F.lit(default)))


def tag_details(users: DataFrame, tags: DataFrame) -> DataFrame:
    """(user_id, tag_names): names of the tags in the csv, in csv order; unknown tags show their id."""
    rows = users.select("user_id", F.posexplode(split_tags("org_tags")).alias("_i", "tag_id"))
    named = rows.join(tags.select("tag_id", "name"), "tag_id", "left")
    packed = named.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("_i", F.coalesce("name", "tag_id").alias("n")))).alias("_l"))
    return users.select("user_id").join(packed, "user_id", "left").select(
        "user_id", F.coalesce(F.array_join(F.transform("_l", lambda x: x["n"]), ","), F.lit("")).alias("tag_names"))


def file_tag_names(files: DataFrame, tags: DataFrame) -> DataFrame:
    """Add ``org_tag_name`` to files: the name of the tag, an unknown tag's id, null without a tag."""
    names = tags.select(F.col("tag_id").alias("org_tag"), F.col("name").alias("_name"))
    return files.join(names, "org_tag", "left").withColumn("org_tag_name", F.coalesce("_name", "org_tag")).drop("_name")


def low_balance(ledger: DataFrame, threshold: int) -> DataFrame:
    """Rows on each user's latest date and token type with balance_after at most ``threshold``.

    The latest date is a combinable aggregate joined back, not a window over all rows of a user.
    """
    latest = ledger.groupBy("user_id", "token_type").agg(F.max("record_date").alias("record_date"))
    return ledger.join(latest, ["user_id", "token_type", "record_date"], "left_semi").where(F.col("balance_after") <= threshold)


def unexecuted(variants: DataFrame, executed: DataFrame) -> DataFrame:
    """Variants of a query that were not run yet (both sides carry query_id, fp)."""
    return variants.join(executed.select("query_id", "fp").distinct(), ["query_id", "fp"], "left_anti")


def retry_lineage(runs: DataFrame) -> DataFrame:
    """(generation_id, root, depth, recovered): the first run of every retry chain. Every run comes out once; a retry of an absent run starts a chain."""
    found = chain_starts(runs, "generation_id", "retry_of")
    return found.join(runs.select("generation_id", "status"), "generation_id").select(
        "generation_id", "root", "depth", ((F.col("depth") > 0) & (F.col("status") == "COMPLETED")).alias("recovered"))


def latest_checkpoints(checkpoints: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Latest checkpoint id per run, and the latest per type prefix (column name to prefix)."""
    per_type = [F.max(F.when(F.col("checkpoint_type").startswith(p), F.col("id"))).alias(c) for c, p in prefixes.items()]
    return checkpoints.groupBy("generation_id").agg(F.max("id").alias("latest_id"), *per_type)


def evidence_references(searches: DataFrame, hits: DataFrame) -> DataFrame:
    """(generation_id, ref_no, doc_id): references of the latest search of a run replace all earlier ones."""
    newest = searches.groupBy("generation_id").agg(F.max("search_id").alias("search_id"))
    numbered = hits.join(newest, "search_id", "inner")
    return numbered.withColumn("ref_no", F.row_number().over(Window.partitionBy("generation_id").orderBy("rank", "doc_id")))


def credit_postings(orders: DataFrame, posted: DataFrame, *, tokens_per_unit: int = 1000) -> DataFrame:
    """One posting per token kind and paid trade number that has none yet; repeats of a trade number post once."""
    paid = orders.where("status = 'SUCCEED'").groupBy("trade_no").agg(F.min(F.struct("order_id", "user_id", "package_units")).alias("_o"))
    fresh = paid.join(posted.select("trade_no").distinct(), "trade_no", "left_anti")
    kinds = F.explode(F.array(F.lit("LLM"), F.lit("EMBEDDING"))).alias("token_type")
    return fresh.select("trade_no", F.col("_o.order_id").alias("order_id"), F.col("_o.user_id").alias("user_id"),
                        (F.col("_o.package_units") * tokens_per_unit).alias("amount"), kinds)
