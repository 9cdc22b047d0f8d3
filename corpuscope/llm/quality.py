"""Quality rules with thresholds learned per language and source.

Every text is measured once. Each measure of a text that passes the base rules goes into a quantile sketch per language and source: logarithmic buckets with a relative
error of ``ACCURACY``, kept as counts, so sketches merge by adding and a third of all rows in one source is pre-aggregated
by every task. The quartiles of a sketch give the fences of its group: a measure is out when it lies more than ``REACH`` spreads
beyond the quartiles, where a spread is the interquartile range or the measure's least spread, whichever is larger. A group of fewer
than ``LEAST_ROWS`` rows takes the merged sketch of its language, or of all rows. Fences are joined back to the rows, and a
document is kept when it passes the base rules and lies within all fences.

Cases: a null text has no words and fails the base rules; null languages and sources form groups of their own; equal rows are
measured one by one; ties share a bucket; an empty table gives no rows. Whole texts are measured. The rows that
pass the base rules feed the sketches, and ``LEAST_ROWS`` counts those: texts that are dropped anyway, being short or mostly repeats, have odd shares that
would widen the fences for the others.
"""

from __future__ import annotations

import string
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.base import map_text, row_key
from corpuscope.session import cut_lineage, join_on_hot_keys

ACCURACY, REACH, LEAST_ROWS, LEAST_WORDS = 0.02, 3.0, 40, 50
#: measure -> least spread: differences below it are never reason enough
MEASURES = {"word_length": 1.0, "symbol_share": 0.02, "mark_share": 0.15, "upper_share": 0.08, "dup_line_share": 0.2, "repeat_share": 0.15}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_upper", "n_lines")
_SPACES, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_MARKS, _UPPER = string.punctuation.encode(), string.ascii_uppercase.encode()


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at space, tab to carriage return, and at nothing else
    runs = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(runs)
    covered = upto = 0
    if len(seen) < len(runs):
        for at, run in enumerate(runs):
            if seen[run] > 1:
                covered += at + 3 - max(at, upto)
                upto = at + 3
    lines = [line for line in data.split(b"\n") if line.strip()]
    among = lambda chars: len(data) - len(data.translate(None, chars))
    return (len(words), len(text or "") - among(_SPACES), among(_SYMBOLS), len(lines) - len(set(lines)), covered,
            among(_MARKS), among(_UPPER), len(lines))


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``_key``, ``lang``, ``source`` and the counts of every row."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), row_key(docs)["text_hash"].alias("text_hash"), docs["lang"].cast("string").alias("lang"),
                       docs["source"].cast("string").alias("source"), docs["text"].cast("string").alias("text"))
    return map_text(rows, "text", ", ".join(f"{c} long" for c in COUNTS), lambda texts: [measure(t) for t in texts])


def measures() -> dict[str, Column]:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"word_length": per("word_chars", "n_words"), "symbol_share": per("n_symbols", "word_chars"), "mark_share": per("n_marks", "word_chars"),
            "upper_share": per("n_upper", "word_chars"), "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words")}


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bucket(value: Column, accuracy: float = ACCURACY) -> Column:
    """Index of the logarithmic bucket of a value of at least zero; all values up to 1e-6 share the first."""
    return F.ceil(F.log(F.greatest(value, F.lit(1e-6)) / 1e-6) / F.log(F.lit((1 + accuracy) / (1 - accuracy)))).cast("int")


def bucket_value(index: Column, accuracy: float = ACCURACY) -> Column:
    growth = (1 + accuracy) / (1 - accuracy)
    return F.when(index <= 0, F.lit(0.0)).otherwise(F.lit(1e-6) * F.pow(F.lit(growth), index) * 2 / (1 + growth))


def sketches(rows: DataFrame) -> DataFrame:
    """Counts per lang, source, measure and bucket, of the rows that pass the base rules."""
    each = F.array(*[F.struct(F.lit(name).alias("measure"), bucket(value).alias("bucket")) for name, value in measures().items()])
    flat = rows.where(~base_failed()).select("lang", "source", F.explode(each).alias("m")).select("lang", "source", "m.measure", "m.bucket")
    return flat.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, by: list[str], reach: float = REACH) -> DataFrame:
    """Per group and measure: number of rows ``rows``, fences ``low`` and ``high``. Sketches of finer groups merge by adding."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")  # at most one row per bucket, whatever the number of documents
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("rows", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("rows") * q), F.col("bucket")))
    quartile = ranked.groupBy(*by, "measure", "rows").agg(bucket_value(at(0.25)).alias("q1"), bucket_value(at(0.75)).alias("q3"))
    least = F.create_map(*[x for name, value in MEASURES.items() for x in (F.lit(name), F.lit(value))])[F.col("measure")]
    spread = reach * F.greatest(F.col("q3") - F.col("q1"), least)
    return quartile.select(*by, "measure", "rows", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))


def _limits(sketch: DataFrame, by: list[str], name: str) -> DataFrame:
    """One row per group with a map from measure to (rows, low, high)."""
    entry = F.struct("measure", F.struct("rows", "low", "high").alias("fence"))
    out = fences(sketch, by).groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias(name))
    return out.select(*[F.col(c).alias(f"{name}_{c}") for c in by], name)


def judge(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, the counts, ``base_failed``, ``out_of`` (measures beyond their fences) and ``kept``."""
    rows = cut_lineage(measured(docs))  # narrow, and read twice: the texts are measured once
    sketch = sketches(rows)
    fine, coarse, whole = _limits(sketch, ["lang", "source"], "fine"), _limits(sketch, ["lang"], "coarse"), _limits(sketch, [], "whole")
    # a group may hold a large share of all rows; keys are structs, in which nulls are equal
    out = rows
    for level, table, by in (("fine", fine, ["lang", "source"]), ("coarse", coarse, ["lang"])):
        group = table.select(F.struct(*[F.col(f"{level}_{c}").alias(c) for c in by]).alias("_group"), level)
        out = join_on_hot_keys(out.withColumn("_group", F.struct(*by)), group, ["_group"], salt_by=["doc_id", "text_hash"], how="left").drop("_group")
    out = out.withColumn("_all", F.lit(0)).join(F.broadcast(whole.withColumn("_all", F.lit(0))), "_all", "left")  # one row
    outside = []
    for name, value in measures().items():
        pick = F.coalesce(*[F.when(F.col(level)[name]["rows"] >= LEAST_ROWS, F.col(level)[name]) for level in ("fine", "coarse")], F.col("whole")[name])
        outside.append(F.when((value < pick["low"]) | (value > pick["high"]), F.lit(name)))
    out = out.withColumn("out_of", F.array_compact(F.array(*outside)))
    return out.select("doc_id", F.struct("doc_id", "text_hash").alias("_key"), *COUNTS, base_failed().alias("base_failed"), "out_of",
                      (~base_failed() & (F.size("out_of") == 0)).alias("kept"))
