"""Line deduplication by overlapping windows of three lines.

Every run of three consecutive lines is hashed (128 bits). A window that occurs more than once in the corpus keeps its
first occurrence, by (doc_id, text hash, position); the lines of every later occurrence are covered, covered positions of
overlapping windows merge, and covered lines are removed. Windows are judged on the input, not on what is left.

Cases: lines are split at ``\\n`` and compared without surrounding white space (space, tab to carriage return). Blank
lines take no part in windows and always stay. A text of fewer than three non-blank lines has no window and stays as it
is; a null text counts as empty and comes out empty. Rows equal in doc_id and text are one document: their windows count
once and each row gets the same result. A null doc_id sorts first. An empty table gives an empty result. Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.base import keyed, salted_join

WINDOW = 3


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def with_lines(rows: DataFrame) -> DataFrame:
    """Adds ``_lines`` (all lines) and ``_used``: (pos, line) of the non-blank ones."""
    out = rows.withColumn("_lines", F.split("_text", "\n", -1))
    numbered = F.transform("_lines", lambda line, i: F.struct(i.alias("pos"), _bare(line).alias("line")))
    return out.withColumn("_used", F.filter(numbered, lambda x: x["line"] != ""))


def window_hashes(used: str, window: int) -> Column:
    """One 128-bit value, as two longs, per run of ``window`` consecutive used lines."""

    def digest(i: Column) -> Column:
        run = [F.get(used, i + j)["line"] for j in range(window)]
        return F.struct(F.xxhash64(*run).alias("a"), F.xxhash64(F.lit("second"), *reversed(run)).alias("b"))

    n = F.size(used) - (window - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), digest))


def covered_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``_key`` and ``_covered``: the line numbers that later occurrences cover, for documents that have any."""
    lines = with_lines(keyed(docs))
    found = (
        lines.withColumn("_hashes", window_hashes("_used", window))
        .select("_key", F.transform("_used", lambda x: x["pos"]).alias("_pos"), F.posexplode_outer("_hashes").alias("_at", "_hash"))
        .where("_at IS NOT NULL")  # the outer form keeps Catalyst from copying the array expressions into a filter below it
        .select("_key", "_at", F.slice("_pos", F.col("_at") + 1, F.lit(window)).alias("_span"), "_hash.a", "_hash.b")
    )
    place = F.struct("_key", "_at")
    # min and max of the place differ exactly when the window occurs at two places; rows that repeat a document do not
    repeated = (
        found.groupBy("a", "b").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where(F.col("_first") < F.col("_last"))
        .select("a", "b", "_first")
    )
    later = salted_join(found, repeated, ["a", "b"], F.xxhash64("_key", "_at")).where(place > F.col("_first"))
    return later.groupBy("_key").agg(F.array_distinct(F.flatten(F.collect_set("_span"))).alias("_covered"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, extra: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``text`` (what is left), ``n_lines``, ``n_removed``, ``n_left`` (non-blank lines left),
    and the columns of ``docs`` named in ``extra``."""
    rows = keyed(docs, *extra)
    both = rows.join(covered_lines(docs, window), "_key", "left")
    lines = both.withColumn("_lines", F.split("_text", "\n", -1))
    everywhere = F.sequence(F.lit(0), F.size("_lines") - 1)
    kept = F.transform(F.array_except(everywhere, F.col("_covered")), lambda i: F.get("_lines", i))
    lines = lines.withColumn("_kept", F.when(F.col("_covered").isNull(), F.col("_lines")).otherwise(kept))
    return lines.select(
        F.col("_id").alias("doc_id"), "_key",
        F.when(F.col("_covered").isNull(), F.col("_text")).otherwise(F.array_join("_kept", "\n")).alias("text"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_kept")).cast("long").alias("n_removed"),
        F.size(F.filter("_kept", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long").alias("n_left"), *extra,
    )
