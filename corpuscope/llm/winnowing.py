"""Benchmark decontamination by winnowing.

The hash of every five-word run is taken, and of each window of ten words (six runs) the smallest hash is kept; neighbouring
windows with the same smallest hash share one fingerprint. Equal windows have equal fingerprints, so every shared span
of ten words or more is found. Training and benchmark fingerprints are joined, and each meeting is extended: the windows
under it are compared word by word, which leaves exact matches only. An item of fewer than ten words is one window; it
keeps the hash of its whole run, and documents keep every run of such a length.

Cases: a null or wordless text has no words, no windows and is never hit. Rows equal in doc_id and text are one document and
get equal results; an item id counts once per document however many rows or windows carry it; items without an id
hit words but are not listed. Windows that many items share are joined once; a text of any length is
worked whole, in time by its length. Empty tables give no hits; columns of other names are left out, whatever they are called. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.base import ascii_lower, keyed, salted_join, small_enough
from corpuscope.session import cut_lineage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 10, 5
#: every text sends a row under one of the marks, so that its words are counted in the pass that finds the hits
TEXT_MARK, MARKS = -(2**62) + 12_345, 1_024


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _fingerprints(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """Adds ``_n`` and ``_low``: per window of words the smallest hash of its ``gram``-word runs."""
    runs = window - gram + 1
    out = rows.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    out = out.withColumn("_n", F.size("_words"))
    gram_hash = F.transform("_hash", lambda h, i: F.xxhash64(h, *[F.get("_hash", i + j) for j in range(1, gram)]))
    out = out.withColumn("_gram", gram_hash)
    whole = F.slice("_gram", F.lit(1), F.greatest(F.col("_n") - window + 1, F.lit(0)))
    return out.withColumn("_low", F.transform(whole, lambda g, i: F.least(g, *[F.get("_gram", i + j) for j in range(1, runs)])))


def item_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``_item``, ``_size``, ``_fp`` and ``_window`` (its words) of every window of every item."""
    rows = items.select(items["item_id"].cast("string").alias("_item"),
                        _words(F.coalesce(items["text"].cast("string"), F.lit(""))).alias("_words"))
    rows = _fingerprints(rows, window, gram).where("_n > 0")
    long = rows.where(F.col("_n") >= window).select("_item", "_words", F.posexplode_outer("_low").alias("_at", "_fp")).where("_at IS NOT NULL").select(
        "_item", F.lit(window).alias("_size"), "_fp", F.array_join(F.slice("_words", F.col("_at") + 1, F.lit(window)), " ").alias("_window"))
    short = rows.where(F.col("_n") < window).select("_item", F.col("_n").alias("_size"), F.xxhash64("_hash").alias("_fp"),
                                                    F.array_join("_words", " ").alias("_window"))
    return long.unionByName(short)


def _document_prints(rows: DataFrame, sizes: list[int], window: int, gram: int) -> list[DataFrame]:
    """Fingerprints of the long windows, and of the runs of each short size: ``_size``, ``_fp`` and the first and last window start
    (``_from``, ``_to``) it stands for, next to ``_key`` and ``_words``.

    They stay apart: each is joined in the stage that makes it, so a text's words are passed on by reference and not copied for every fingerprint.
    """
    # the outer forms of explode keep Catalyst from copying the whole chain of array expressions into a filter below it
    out = _fingerprints(rows, window, gram)
    starts = F.filter(F.sequence(F.lit(0), F.size("_low") - 1), lambda i: (i == 0) | (F.get("_low", i) != F.get("_low", i - 1)))
    # the start -1 stands for the text itself and meets the text mark, so that its number of words comes out of the same pass
    found = F.when(F.size("_low") > 0, starts).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("_starts", F.concat(F.array(F.lit(-1)), found))
    at, begin = F.col("_nth"), F.col("_from")
    parts = [
        out.select("_key", "_words", "_n", "_low", "_starts", F.posexplode_outer("_starts").alias("_nth", "_from")).where("_from IS NOT NULL").select(
            "_key", "_words", "_n", F.lit(window).alias("_size"), F.when(begin < 0, _mark(F.xxhash64("_key"))).otherwise(F.get("_low", begin)).alias("_fp"), "_from",
            F.when(begin < 0, -1).otherwise(F.coalesce(F.get("_starts", at + 1), F.size("_low")) - 1).alias("_to"))
    ]
    for size in sizes:
        every = F.when(F.col("_n") >= size, F.sequence(F.lit(0), F.col("_n") - size))
        spots = out.select("_key", "_words", "_n", "_hash", F.explode_outer(every).alias("_from")).where("_from IS NOT NULL")
        parts.append(spots.select("_key", "_words", "_n", F.lit(size).alias("_size"), F.xxhash64(F.slice("_hash", begin + 1, F.lit(size))).alias("_fp"),
                                  "_from", begin.alias("_to")))
    return parts


def _mark(number: Column) -> Column:
    return F.lit(TEXT_MARK) + F.pmod(number, F.lit(MARKS))


def _extended(met: DataFrame) -> DataFrame:
    """Every window start under a meeting whose words are those of the item window."""
    spread = met.withColumn("_at", F.explode(F.sequence("_from", "_to")))
    own = F.array_join(F.slice("_words", F.greatest(F.col("_at") + 1, F.lit(1)), F.col("_size")), " ")
    return spread.where((F.col("_at") < 0) & F.col("_window").isNull() | (F.col("_at") >= 0) & (own == F.col("_window"))).select("_key", "_n", "_at", "_size", "_window")


def hits(docs: DataFrame, windows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``_key``, ``_n`` (words), ``_at``, ``_size``, ``_window`` of every occurrence of an item window, and one row with ``_at`` -1 for every text."""
    mark = docs.sparkSession.range(MARKS).select(F.lit(window).alias("_size"), _mark(F.col("id")).alias("_fp"), F.lit(None).cast("string").alias("_window"))
    distinct = windows.select("_size", "_fp", "_window").distinct().unionByName(mark)
    sizes = sorted(r[0] for r in windows.where(F.col("_size") < window).select("_size").distinct().collect())  # at most window - 1 numbers
    rows = keyed(docs).select("_key", _words(F.col("_text")).alias("_words"))
    parts = _document_prints(rows, sizes, window, gram)
    if small_enough(distinct):
        found = [_extended(part.join(F.broadcast(distinct), ["_size", "_fp"])) for part in parts]
    else:
        # a fingerprint that many documents share is spread by document
        slim = [salted_join(part.drop("_words"), distinct, ["_size", "_fp"], F.xxhash64("_key")).select("_key", "_n", "_from", "_to", "_size", "_window") for part in parts]
        found = [_extended(met.join(rows.dropDuplicates(["_key"]), "_key")) for met in slim]
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole


def _covered(spans: Column) -> Column:
    """Number of words under a sorted array of (start, end)."""
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("upto"))

    def add(state: Column, span: Column) -> Column:
        fresh = F.greatest(F.lit(0), span["end"] - F.greatest(span["start"], state["upto"]))
        return F.struct((state["total"] + fresh).alias("total"), F.greatest(state["upto"], span["end"]).alias("upto"))

    return F.aggregate(spans, zero, add)["total"]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit``, ``items`` (sorted ids as strings), ``spans`` of hit words, ``contaminated``."""
    windows = item_windows(items, window, gram)
    seen = cut_lineage(hits(docs, windows, window, gram))  # read below; narrow beside the texts, which are read once
    found = seen.where("_at >= 0")
    span = F.struct(F.col("_at").alias("start"), (F.col("_at") + F.col("_size")).alias("end"))
    spans = found.groupBy("_key").agg(F.sort_array(F.collect_set(span)).alias("spans"))
    members = windows.where(F.col("_item").isNotNull()).select("_window", "_item").distinct()
    listed = (
        salted_join(found.select("_key", "_window").distinct(), members, ["_window"], F.xxhash64("_key")).select("_key", "_item").distinct()
        .groupBy("_key").agg(F.sort_array(F.collect_list("_item")).alias("items"))
    )
    rows = seen.where("_at < 0").select("_key", F.col("_key.doc_id").alias("_id"), F.col("_n").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    out = rows.join(spans.join(listed, "_key", "left"), "_key", "left")
    return out.select(F.col("_id").alias("doc_id"), "_key", "n_words",
                      F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("items", none).alias("items"), "spans", F.col("spans").isNotNull().alias("contaminated"))
