"""Exact quantiles of whole numbers without a counter per value.

A pass counts the values of every group in ``BINS`` equal bins between its bounds and keeps the bin that holds the rank; the next pass refines that bin. A group
costs ``BINS`` counters in a task whatever its values, and the passes grow with the logarithm of the range. Where the range itself bounds the distinct
values of every group, the built-in aggregate does it in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.session import cut_lineage, join_on_hot_keys

BINS, NARROW = 1_024, 65_536


def exact_quantile(df: DataFrame, keys: list[str], value: Column, q: float, name: str, *, bins: int = BINS, narrow: int = NARROW) -> DataFrame:
    """(keys, ``name``): the smallest value of each group whose share of values up to it is ``q`` or more; groups without a value have no row."""
    key = keys or ["_all"]
    rows = df.select(*keys, *([] if keys else [F.lit(0).alias("_all")]), value.cast("long").alias("_v")).where("_v IS NOT NULL")
    bounds = rows.groupBy(*key).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n")).withColumn("_before", F.lit(0).cast("long"))
    if bounds.where(F.col("_hi") - F.col("_lo") >= narrow).isEmpty():
        found = rows.groupBy(*key).agg(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY _v)").cast("long").alias(name))
        return found if keys else found.drop("_all")
    rows, bounds = cut_lineage(rows), cut_lineage(bounds)  # read in every pass
    known = bounds.where("_lo = _hi").select(*key, F.col("_lo").alias(name))
    open_ = bounds.where("_lo < _hi")
    while not open_.isEmpty():
        width = F.ceil((F.col("_hi") - F.col("_lo") + 1) / bins).cast("long")
        met = join_on_hot_keys(rows, open_.withColumn("_w", width), key, salt_by=["_v"]).where("_v BETWEEN _lo AND _hi")
        counts = met.groupBy(*key, "_lo", "_hi", "_n", "_before", "_w", F.expr("(_v - _lo) div _w").alias("_bin")).agg(F.count("*").alias("_c"))
        upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*key).orderBy("_bin"))
        reach = counts.withColumn("_upto", upto).where(F.col("_upto") / F.col("_n") >= q)
        first = reach.groupBy(*key).agg(F.min(F.struct("_bin", "_lo", "_hi", "_n", "_w", (F.col("_upto") - F.col("_c")).alias("_before"))).alias("_f")).select(*key, "_f.*")
        low = F.col("_lo") + F.col("_bin") * F.col("_w")
        refined = cut_lineage(first.select(*key, low.alias("_lo"), F.least(F.col("_hi"), low + F.col("_w") - 1).alias("_hi"), "_n", "_before"))
        known = known.unionByName(refined.where("_lo = _hi").select(*key, F.col("_lo").alias(name)))
        open_ = refined.where("_lo < _hi")
    return known if keys else known.drop("_all")
