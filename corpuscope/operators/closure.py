"""Transitive closures of parent links by pointer doubling: about log2(depth) equi-join rounds, no limit on depth.

A parent may have a large share of all children: the side that is looked up is broadcast by its counted size; beyond it, ancestors spread the children of a parent over salts, and chains look up
parents with many children by broadcast and all others by a plain join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.session import BROADCAST_ROWS, cut_lineage, join_on_hot_keys, task_count

#: rows of one key above which it is looked up apart from the others
HOT_ROWS = 100_000


def ancestors(links: DataFrame, child: str, parent: str) -> DataFrame:
    """(``child``, ancestor, depth) of every child, itself at depth 0 included; on a cycle the least depth counts.

    A parent that is no child itself is an ancestor and ends the chain. Children are unique.
    """
    nodes = links.select(F.col(child).alias("node"), F.col(parent).alias("up"))
    jump = cut_lineage(nodes.where("up IS NOT NULL"))  # the ancestor at exactly ``reach`` steps
    known = cut_lineage(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
                        .unionByName(jump.select("node", F.col("up").alias("ancestor"), F.lit(1).alias("depth")))
                        .groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
    reach, count = 1, known.count()
    while True:
        fits = count <= BROADCAST_ROWS  # there are no more jumps than known pairs
        farther = known.where("depth > 0").withColumnRenamed("node", "up")
        beyond = join_on_hot_keys(jump, farther, ["up"], salt_by=["node"], small_fits=fits).select("node", "ancestor", (F.col("depth") + reach).alias("depth"))
        grown = cut_lineage(known.unionByName(beyond).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
        now = grown.count()
        if now == count:
            return grown.select(F.col("node").alias(child), "ancestor", "depth")
        known, count = grown, now
        doubled = join_on_hot_keys(jump, jump.select(F.col("node").alias("up"), F.col("up").alias("_next")), ["up"], salt_by=["node"], small_fits=fits)
        jump = cut_lineage(doubled.select("node", F.col("_next").alias("up")))
        reach *= 2


def _looked_up(rows: DataFrame, side: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join with ``side``, unique in ``key``. Keys of more than ``HOT_ROWS`` rows are few: they are looked up by broadcast, so that nothing is repeated for the others."""
    hot = cut_lineage(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS).select(key))
    if hot.isEmpty():
        return rows.join(side, key, how)
    hot = F.broadcast(hot)
    ours = rows.join(hot, key, "left_semi").join(F.broadcast(side.join(hot, key, "left_semi")), key, how)
    return rows.join(hot, key, "left_anti").join(side, key, how).unionByName(ours)


def chain_starts(links: DataFrame, node: str, parent: str) -> DataFrame:
    """(``node``, root, depth): the first node of the chain that each node hangs on.

    A node whose parent is null or absent is its own root. Nodes that lead into a cycle have no first node; each is its own root at depth 0.
    """
    every = cut_lineage(links.select(F.col(node).alias("node"), F.col(parent).alias("_parent")))
    there = every.select(F.col("node").alias("_parent"), F.lit(True).alias("_there"))
    # rows without a parent need no lookup: a join would bring all of them to one task
    first = every.where("_parent IS NULL").withColumn("_there", F.lit(None).cast("boolean"))
    state = cut_lineage(_looked_up(every.where("_parent IS NOT NULL"), there, "_parent", "left").unionByName(first).select(
        "node", F.when(F.col("_there"), F.col("_parent")).otherwise(F.col("node")).alias("root"),
        F.when(F.col("_there"), 1).otherwise(0).alias("depth"), F.col("_there").isNull().alias("done")))
    total = state.count()
    for _ in range(max(1, total).bit_length() + 1):
        if not state.where("NOT done").limit(1).count():
            break
        ahead = state.select(F.col("node").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        waiting = state.where("NOT done")
        met = waiting.join(F.broadcast(ahead), "root") if total <= BROADCAST_ROWS else _looked_up(waiting, ahead, "root")
        moved = met.select("node", F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done"))
        state = cut_lineage(state.where("done").unionByName(moved).coalesce(task_count(links.sparkSession)))  # unions add their partitions up
    out = state.select(F.col("node").alias(node), F.when(F.col("done"), F.col("root")).otherwise(F.col("node")).alias("root"),
                       F.when(F.col("done"), F.col("depth")).otherwise(0).alias("depth"))
    return out
