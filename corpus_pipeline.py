"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.

Rows equal in doc_id and text are one document for every stage: they go or stay together, except in the near-duplicate stage, which
keeps one row of each group. Extra columns of the input, whatever they are called, do not pass the first stage.

Cases: a null text counts as empty; empty texts are near duplicates of each other, so one stays; a null doc_id stays null and is the smallest of a group; very long texts are worked
whole; rows equal in doc_id and text with other values in the remaining columns leave one of them in the near-duplicate stage; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm import line_windows, pieces, simhash, toxicity, winnowing
from corpuscope.llm.base import read, row_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _kept(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is in the ``_key`` column of ``keys``."""
    held = docs.select(*COLUMNS).withColumn("_key", row_key(docs))
    return held.join(keys.select("_key"), "_key", "left_semi").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    rows = docs.select(*COLUMNS).withColumn("scored", docs["text"])
    return toxicity.with_scores(rows, "scored", model).where("score < 0.5").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of repeated windows; a document of which no line is left was a copy and goes."""
    out = line_windows.dedup_lines(docs, extra=("lang", "source", "n_chars"))
    kept = out.where("n_removed = 0 OR n_left > 0")
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars").cast("long"))
    return kept.select("doc_id", "text", "lang", "source", changed.alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest doc_id, and of its rows the one of smallest text hash."""
    held = docs.select(*COLUMNS).withColumn("_key", row_key(docs))
    return held.join(simhash.survivors(docs), "_key", "left_semi").dropDuplicates(["_key"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = winnowing.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return _kept(docs, found.where(~F.col("contaminated")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_ids`` and the piece ids of every text."""
    out = pieces.encoded(docs)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [("toxicity", drop_toxic), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]

#: toxicity scores, fingerprint components and piece ids are not expressible in SQL; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
