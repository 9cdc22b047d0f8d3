"""Readers of the given parquet tables; files of other formats are read by ``files``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GIVEN_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
                "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
