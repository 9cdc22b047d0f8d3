"""Registered queries of the operators: thin digests of their outputs over whole tables, and SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm import alignment, chat_events, disclosure, html_main, line_windows, pieces, quality, simhash, suffix_dedup, toxicity, warc, whitening, winnowing
from corpuscope.llm import oracles
from corpuscope.llm.base import read, sha256_hex
from corpuscope.session import ship_package

Run = Callable[[SparkSession, str], DataFrame]


def op1_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_main.extract(read(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).drop("text_hash")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).drop("_key")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], turns.schema)
    log = chat_events.events_of(turns.unionByName(own))
    back = chat_events.read_back(chat_events.render(chat_events.fold(log)))
    said: Column = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha256_hex(said).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), sha256_hex(F.col("loss_text")).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def op6_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = disclosure.find(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(disclosure.KINDS))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(i).eqNullSafe)).cast("long").alias(f"n_{k}") for i, k in enumerate(disclosure.KINDS)]
    return out.select("doc_id", *counts, sha256_hex(disclosure.listed(base)).alias("base_sha256"), disclosure.listed(F.col("spans")).alias("spans"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnowing.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      sha256_hex(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(read(spark, sf_dir, "documents")).drop("text_hash")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_windows.dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_left", F.length("text").cast("long").alias("n_chars_left"),
                      sha256_hex(F.col("text")).alias("kept_sha256"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.linked(read(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_archives(read(spark, sf_dir, "pages"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def shipped(run: Run) -> Run:
    """``run`` after giving this package to the Python workers."""

    def with_package(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return run(spark, sf_dir)

    return with_package


QUERIES: dict[str, Run] = {
    "op1_html_main": op1_html_main,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_chat_format": op5_chat_format,
    "op6_disclosure": op6_disclosure,
    "op7_winnowing": op7_winnowing,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality": op9_quality,
    "op10_line_windows": op10_line_windows,
    "op11_alignment": op11_alignment,
    "op12_warc": op12_warc,
    "op13_whitening": op13_whitening,
}

SQL: dict[str, str] = {
    "op5_chat_format": oracles.CHAT,
    "op6_disclosure": oracles.DISCLOSURE,
    "op7_winnowing": oracles.WINNOWING,
    "op9_quality": oracles.QUALITY,
    "op10_line_windows": oracles.LINE_WINDOWS,
    "op12_warc": oracles.WARC,
}


def queries() -> dict[str, Run]:
    import corpus_pipeline

    return {name: shipped(run) for name, run in QUERIES.items()} | {"pipeline": shipped(corpus_pipeline.run)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
