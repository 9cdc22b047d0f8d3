"""Retries as a loop inside a stream: what fails is written to a folder that is the second source of the same query.

Each micro-batch works its new tasks and the failed ones of earlier batches, and writes what succeeded, what is to be tried again and what is dead to folders of its own,
named by the batch. A batch that runs again after a crash has the same input and replaces its own folders, so no task is doubled or lost, wherever it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from corpuscope.session import cut_lineage

MAX_ATTEMPTS = 5


def _empty_folder(spark, path: str, schema: StructType) -> None:
    """A folder that a stream can read from before anything is in it."""
    try:
        spark.read.parquet(path)
    except AnalysisException:
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/batch=-1")


def retry_stream(tasks: DataFrame, work: Callable[[DataFrame], DataFrame], base: str, max_attempts: int = MAX_ATTEMPTS) -> StreamingQuery:
    """Start one run over all that is available now. ``work`` adds a boolean ``ok`` to its rows, which carry the number of their ``attempt``.

    Below ``base``: ``done`` and ``dead`` (with the attempt at which a task ended), ``failed`` (to be tried again) and the state of the query.
    """
    spark = tasks.sparkSession
    schema = StructType([*tasks.schema.fields, StructField("attempt", IntegerType())])
    for name in ("done", "dead", "failed"):
        _empty_folder(spark, f"{base}/{name}", schema)
    first = tasks.withColumn("attempt", F.lit(1))
    again = spark.readStream.schema(schema).parquet(f"{base}/failed").select(*tasks.columns, (F.col("attempt") + 1).alias("attempt"))

    def run(batch: DataFrame, batch_id: int) -> None:
        tried = cut_lineage(work(batch))  # worked once, read three times
        failed = ~F.coalesce("ok", F.lit(False))
        for name, rows in (("done", ~failed), ("dead", failed & (F.col("attempt") >= max_attempts)), ("failed", failed & (F.col("attempt") < max_attempts))):
            tried.where(rows).drop("ok").write.mode("overwrite").parquet(f"{base}/{name}/batch={batch_id}")

    return (first.unionByName(again).writeStream.foreachBatch(run).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())


def drain_with_retries(tasks: DataFrame, work: Callable[[DataFrame], DataFrame], base: str, max_attempts: int = MAX_ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """(done, dead) when nothing is left to try. A run sees what failed before it, so there are at most ``max_attempts`` of them with rows, and one without."""
    for _ in range(max_attempts + 1):
        query = retry_stream(tasks, work, base, max_attempts)
        query.awaitTermination()
        if not any(p["numInputRows"] for p in query.recentProgress):
            break
    spark = tasks.sparkSession
    return spark.read.parquet(f"{base}/done").drop("batch"), spark.read.parquet(f"{base}/dead").drop("batch")
