"""Token and request usage: daily sums, trends, balances, quotas, alerts, rankings, reservations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions.times import micros
from corpuscope.operators.access import first_rows

# --- fixed values -----------------------------------------------------------------------------
MAX_TREND_DAYS, RETENTION_DAYS, TOP_CONSUMERS = 35, 35, 5
WARNING_RATIO = 0.8
# ----------------------------------------------------------------------------------------------


def daily_usage(ledger: DataFrame, token_type: str, start: str, end: str) -> DataFrame:
    """(record_date, amount, requests) of consumption of one token type in a closed date range."""
    rows = ledger.where((F.col("change_type") == "CONSUME") & (F.col("token_type") == token_type)
                        & F.col("record_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return rows.groupBy("record_date").agg(F.sum("amount").alias("amount"), F.sum("request_count").alias("requests"))


def daily_counts(rows: DataFrame, count: str = "count") -> DataFrame:
    return rows.groupBy("record_date").agg(F.sum(count).alias("count"))


def trend(start: str, days: int, spark_df: DataFrame, series: dict[str, DataFrame]) -> DataFrame:
    """One row per day without gaps; ``series`` maps a column name to (record_date, value) rows, gaps are zero."""
    last = max(1, min(MAX_TREND_DAYS, days)) - 1
    spine = spark_df.sparkSession.range(0, last + 1).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("record_date"))
    out = spine
    for name, rows in series.items():
        out = out.join(rows.select("record_date", F.col("value").alias(name)), "record_date", "left")
    return out.fillna(0, list(series))


def totals_by_kind(ledger: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sum of amount per wanted (user_id, token_type, change_type), zero where nothing was booked."""
    sums = ledger.groupBy("user_id", "token_type", "change_type").agg(F.sum("amount").alias("total"))
    return wanted.join(sums, ["user_id", "token_type", "change_type"], "left").withColumn("total", F.coalesce("total", F.lit(0)))


def daily_rollup(ledger: DataFrame) -> DataFrame:
    """(user_id, record_date, token_type): amount, requests, first balance before, last balance after."""
    return ledger.where("change_type = 'CONSUME'").groupBy("user_id", "record_date", "token_type").agg(
        F.sum("amount").alias("amount"), F.count("*").alias("requests"), F.min_by("balance_before", "event_id").alias("balance_before"),
        F.max_by("balance_after", "event_id").alias("balance_after"))


def running(df: DataFrame, keys: list[str], value: Column, name: str, *, position: Column, tie: str | None = None, how: str = "sum",
            inclusive: bool = True, block_size: int = 100_000) -> DataFrame:
    """Running ``sum`` or ``max`` per key in the order of a whole number ``position`` (then ``tie``), with a hot key spread
    over blocks of positions.

    Rows are windowed inside (key, block); the block results, one row per key and block, are accumulated on their own and
    joined back. No task ever holds more than one block of a key. Before the first value a sum is 0 and a max is null.
    The max of a struct that starts with the position is the latest row so far, so it stands in for ``lag`` and ``last``.
    """
    combine = F.sum if how == "sum" else F.max
    rows = df.withColumn("_v", value).withColumn("_pos", position).withColumn("_block", F.floor(F.col("_pos") / block_size))
    totals = rows.groupBy(*keys, "_block").agg(combine("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_block", combine("_t").over(before).alias("_start"))
    order = ["_pos", tie] if tie else ["_pos"]
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = rows.withColumn("_local", combine("_v").over(inside)).join(starts, [*keys, "_block"])
    if how == "sum":
        result = F.coalesce("_start", F.lit(0)) + F.coalesce("_local", F.lit(0))
    else:
        result = F.greatest("_start", "_local")
    return joined.withColumn(name, result).drop("_v", "_pos", "_block", "_local", "_start")


#: block of time for running values over timestamps: one hour in microseconds
HOUR_BLOCK = 3_600_000_000


def running_balance(ledger: DataFrame, grants: DataFrame) -> DataFrame:
    """Balance after every booking: the grant of (user_id, token_type) plus increases minus consumption. It may go negative."""
    signed = F.when(F.col("change_type") == "INCREASE", F.col("amount")).otherwise(-F.col("amount"))
    moved = running(ledger, ["user_id", "token_type"], signed, "_moved", position=micros("ts"), tie="event_id", block_size=HOUR_BLOCK)
    joined = moved.join(grants.select("user_id", "token_type", "initial"), ["user_id", "token_type"], "left")
    return joined.withColumn("balance_after", F.coalesce("initial", F.lit(0)) + F.col("_moved")).drop("_moved", "initial")


def quota_view(ledger: DataFrame, limits: DataFrame) -> DataFrame:
    """(user_id, scope): used, limit, remaining, requests; the limit table is (scope, day_max_tokens)."""
    used = ledger.where("change_type = 'CONSUME'").groupBy("user_id", F.col("token_type").alias("scope")).agg(
        F.sum("amount").alias("used"), F.count("*").alias("requests"))
    return used.join(limits, "scope").select(
        "user_id", "scope", "used", F.col("day_max_tokens").alias("limit_tokens"),
        F.greatest(F.col("day_max_tokens") - F.col("used"), F.lit(0)).alias("remaining"), "requests")


def quota_alerts(views: DataFrame) -> DataFrame:
    """(user_id, scope, level, ratio): critical at nothing remaining, warning from the warning ratio; critical first."""
    ratio = F.when(F.col("limit_tokens") > 0, F.col("used") / F.col("limit_tokens")).otherwise(0.0)
    level = F.when(F.col("remaining") <= 0, "critical").when(ratio >= WARNING_RATIO, "warning")
    rows = views.withColumn("ratio", F.round(ratio, 4)).withColumn("level", level).where("level IS NOT NULL")
    return rows.select("user_id", "scope", "level", "ratio", "used", "limit_tokens")


def alert_order() -> list[Column]:
    return [F.when(F.col("level") == "critical", 0).otherwise(1), F.desc("ratio"), F.asc("user_id"), F.asc("scope")]


def balance_alerts(rollup: DataFrame) -> DataFrame:
    """Users whose balance ran out (critical) or has at most a fifth left (warning); remaining_ratio = after / before."""
    ratio = F.when(F.col("balance_before") > 0, F.col("balance_after") / F.col("balance_before")).otherwise(0.0)
    level = F.when(F.col("balance_after") <= 0, "critical").when(ratio <= 1 - WARNING_RATIO, "warning")
    return rollup.withColumn("remaining_ratio", F.round(ratio, 4)).withColumn("level", level).where("level IS NOT NULL")


def top_consumers(ledger: DataFrame, day: str, n: int = TOP_CONSUMERS) -> DataFrame:
    """The ``n`` largest consumers of a day per scope; users without use are left out."""
    used = ledger.where((F.col("change_type") == "CONSUME") & (F.col("record_date") == F.lit(day).cast("date"))).groupBy(
        F.col("token_type").alias("scope"), "user_id").agg(F.sum("amount").alias("used")).where("used > 0")
    return first_rows(used, ["scope"], [F.desc("used"), F.asc("user_id")], n, "rank")


def clock_counters(events: DataFrame, *, window: str = "1 day", keys: tuple[str, ...] = ("user_id",), watermark: str | None = None) -> DataFrame:
    """(window_start, keys, requests, tokens) on clock-aligned windows; for streams give a watermark."""
    source = events.withWatermark("ts", watermark) if watermark else events
    return (source.groupBy(F.window("ts", window).alias("w"), *keys).agg(F.count("*").alias("requests"), F.sum("amount").alias("tokens"))
            .select(F.col("w.start").alias("window_start"), *keys, "requests", "tokens"))


def within_retention(counters: DataFrame, today: Column, days: int = RETENTION_DAYS, day: str = "record_date") -> DataFrame:
    return counters.where(F.col(day) >= F.date_sub(today, days))


def settle(reservations: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per (quota_key): reserved, final usage and overrun after settlement or release.

    ``reservations``: id, quota_key, reserved, limit_tokens. ``outcomes``: id, outcome (settle or abort), actual. A
    reservation without outcome counts in full; an outcome without reservation is ignored.
    """
    joined = reservations.join(outcomes, "id", "left")
    final = (F.when(F.col("outcome") == "settle", F.col("actual")).when(F.col("outcome") == "abort", 0).otherwise(F.col("reserved")))
    return joined.groupBy("quota_key").agg(
        F.sum("reserved").alias("reserved"), F.sum(final).alias("used"), F.count_if(F.col("outcome") == "settle").alias("settled"),
        F.count_if(F.col("outcome") == "abort").alias("aborted"), F.max("limit_tokens").alias("limit_tokens"),
        (F.sum(final) > F.max("limit_tokens")).alias("overrun"))
