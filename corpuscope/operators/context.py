"""Prompt material: numbered context, tool text, message compaction; admission by a running budget that skips what does not fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.text import CONTEXT_SNIPPET_LENGTH, TOOL_TEXT_LENGTH, limit_text, limit_text_within
from corpuscope.operators.usage import running
from corpuscope.session import cut_lineage

# --- fixed values -----------------------------------------------------------------------------
MAX_PROMPT_CHARS, MAX_TOOL_CHARS, MAX_MESSAGE_CHARS = 32000, 8000, 1600
TRUNCATED_SUFFIX = "\n[内容已截断]"
# ----------------------------------------------------------------------------------------------

#: rows of a group up to which it is folded in one pass; rows of a block, and pieces of its map, beyond
FOLD_ROWS, BLOCK_ROWS, PIECES = 1_000_000, 65_536, 1_024


def context_pack(hits: DataFrame) -> DataFrame:
    """(query_id, context): '[i] (file | page) snippet' lines in rank order; a query has at most its top-k hits."""
    page = F.when(F.col("page") > 0, F.concat(F.lit(" | 第"), F.col("page").cast("string"), F.lit("页"))).otherwise("")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), F.coalesce("file_name", F.lit("unknown")), page, F.lit(") "),
                    limit_text("text", CONTEXT_SNIPPET_LENGTH), F.lit("\n"))
    packed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))).alias("_l"))
    return packed.select("query_id", F.array_join(F.transform("_l", lambda x: x["l"]), "").alias("context"))


def tool_text(hits: DataFrame) -> DataFrame:
    """(query_id, content): head line and one block of at most 1200 characters per hit."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce(F.concat("file_name", F.lit(" ")), F.lit("")), F.lit("(doc="),
                     F.col("doc_id").cast("string"), F.lit(", score="), F.format_string("%.4f", "score"), F.lit(")\n"), limit_text("text", TOOL_TEXT_LENGTH))
    packed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("_l"), F.count("*").alias("_n"))
    return packed.select("query_id", F.concat(F.lit("检索到 "), F.col("_n").cast("string"), F.lit(" 个知识库片段。\n\n"),
                                              F.array_join(F.transform("_l", lambda x: x["b"]), "\n\n")).alias("content"))


def admit(rows: DataFrame, key: list[str], order: Column, amount: str, limit: str, *, used: str | None = None, first_always: bool = False,
          fold_rows: int = FOLD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``admitted``: rows of a key in order are taken when they still fit into the limit; a row that does not fit is
    skipped and uses nothing. ``order`` must be a total order of whole numbers; amounts are not negative.

    Groups up to ``fold_rows`` rows are folded in one sorted pass that keeps one total. Larger groups are cut into blocks of ``block_rows``: every block is summarised, on its own,
    by the map from what is left before it to what is left behind it; one pass over these maps, not over rows, gives what is left before each; and each block
    is then folded from there. A hot group takes a fixed number of jobs, whatever its size, and its rows are spread over its blocks.
    """
    start = F.col(used) if used else F.lit(0)
    base = rows.withColumn("_o", order.cast("long")).withColumn("_a", F.col(amount).cast("long")).withColumn("_left", (F.col(limit) - start).cast("long"))
    sizes = base.groupBy(*key).agg(F.count("*").alias("_n"))
    hot = sizes.where(F.col("_n") > fold_rows).select(*key)
    if hot.isEmpty():
        return _admit_fold(base, key, first_always).drop("_o", "_a", "_left")
    hot = cut_lineage(hot)
    small = _admit_fold(base.join(hot, key, "left_anti"), key, first_always)
    large = _admit_blocks(cut_lineage(base.join(hot, key, "left_semi")), key, first_always, block_rows)
    return small.unionByName(large).drop("_o", "_a", "_left")


def _admit_fold(base: DataFrame, key: list[str], first_always: bool) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + ", admitted boolean"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, left, taken = None, 0, False
        for pdf in batches:
            flags = np.zeros(len(pdf), dtype=bool)
            for i, (k, a, whole) in enumerate(zip(zip(*[pdf[c] for c in key]), pdf["_a"], pdf["_left"])):
                if k != current:
                    current, left, taken = k, whole, False
                if a <= left or (first_always and not taken):
                    flags[i], taken, left = True, True, left - a
            yield pdf.assign(admitted=flags)

    return base.repartition(*key).sortWithinPartitions(*key, "_o").mapInPandas(walk, schema)


def after(breaks: np.ndarray, shifts: np.ndarray, amount: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The map of a block with one more row of ``amount``.

    A map tells what is left behind a block from what is left before it, x: from ``breaks[i]`` on, up to the next break, it is x - ``shifts[i]``. A row takes its amount from
    every x that still has it, so a piece is moved as a whole, cut in two, or left alone. Nothing above ``most`` can be left.
    """
    point = shifts + amount  # from here on the row fits
    ends = np.append(breaks[1:], most + 1)
    cut = np.flatnonzero((point > breaks) & (point < ends))
    shifts = np.insert(np.where(point <= breaks, shifts + amount, shifts), cut + 1, shifts[cut] + amount)
    breaks = np.insert(breaks, cut + 1, point[cut])
    new = np.append(True, shifts[1:] != shifts[:-1])
    return breaks[new], shifts[new]


def _groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """(key, rows) of every group of a partition that is sorted by key; one group is held at a time."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        keys = list(zip(*[pdf[c] for c in key]))
        edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]]
        for lo, hi in zip(edges[:-1], edges[1:]):
            yield keys[lo], pdf.iloc[lo:hi]
        rest = pdf.iloc[edges[-1] :].reset_index(drop=True)
    if rest is not None and len(rest):
        yield tuple(rest[c].iat[0] for c in key), rest


def _admit_blocks(rows: DataFrame, key: list[str], first_always: bool, block_rows: int, pieces: int = PIECES) -> DataFrame:
    """Hot groups by maps of blocks. A map that gets more than ``pieces`` pieces is closed and the rest of its block summarised by another one."""
    settled: list[DataFrame] = []
    if first_always:
        firsts = rows.groupBy(*key).agg(F.min("_o").alias("_first"), F.min_by("_a", "_o").alias("_fa"))
        rows = cut_lineage(rows.join(firsts, key))
        settled.append(rows.where("_o = _first").drop("_first", "_fa").withColumn("admitted", F.lit(True)))
        rows = rows.where("_o > _first").withColumn("_left", F.col("_left") - F.col("_fa")).drop("_first", "_fa")
    settled.append(rows.where("_a > _left").withColumn("admitted", F.lit(False)))  # never fits
    numbered = running(rows.where("_a <= _left"), key, F.lit(1), "_nth", position=F.col("_o"))
    placed = cut_lineage(numbered.withColumn("_blk", F.floor((F.col("_nth") - 1) / block_rows)))
    block = [*key, "_blk"]
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    names = ", ".join(f"`{k}` {kinds[k]}" for k in block)

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group, part in _groups(batches, block):
            most, made = int(part["_left"].iat[0]), []
            lowest = np.array([np.iinfo(np.int64).min // 2])
            breaks, shifts = lowest, np.zeros(1, np.int64)
            for amount in part["_a"].to_numpy():
                breaks, shifts = after(breaks, shifts, int(amount), most)
                if len(breaks) > pieces:
                    made.append((breaks, shifts))
                    breaks, shifts = lowest, np.zeros(1, np.int64)
            made.append((breaks, shifts))
            yield pd.DataFrame({**{k: [v] * len(made) for k, v in zip(block, group)}, "sub": range(len(made)), "breaks": [m[0] for m in made], "shifts": [m[1] for m in made], "most": most})

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, left = None, 0
        for pdf in batches:
            found = []
            for i, (k, b, sub, breaks, shifts, most) in enumerate(zip(zip(*[pdf[c] for c in key]), pdf["_blk"], pdf["sub"], pdf["breaks"], pdf["shifts"], pdf["most"])):
                if k != current:
                    current, left = k, most
                if sub == 0:
                    found.append((*k, b, left))
                left -= int(shifts[np.searchsorted(breaks, left, "right") - 1])
            yield pd.DataFrame(found, columns=[*block, "_entry"])

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, part in _groups(batches, block):
            left, flags = int(part["_entry"].iat[0]), []
            for amount in part["_a"].tolist():
                flags.append(amount <= left)
                left -= amount if flags[-1] else 0
            yield part.assign(admitted=flags)

    ordered = placed.repartition(*block).sortWithinPartitions(*block, "_nth")
    maps = ordered.select(*block, "_nth", "_a", "_left").mapInPandas(summarise, f"{names}, sub int, breaks array<bigint>, shifts array<bigint>, most bigint")
    entries = cut_lineage(maps).repartition(*key).sortWithinPartitions(*block, "sub").mapInPandas(follow, f"{names}, _entry bigint")
    met = placed.join(entries, block).repartition(*block).sortWithinPartitions(*block, "_nth")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema.fields) + ", admitted boolean"
    settled.append(met.mapInPandas(replay, schema).drop("_nth", "_blk", "_entry"))
    result = settled[0]
    for part in settled[1:]:
        result = result.unionByName(part.select(*result.columns))
    return result


def normalized_message() -> Column:
    """Old user and assistant messages and tool results cut to their limits; system messages stay whole."""
    return (F.when(F.col("role") == "system", F.col("content"))
            .when(F.col("role") == "tool", limit_text_within("content", MAX_TOOL_CHARS, TRUNCATED_SUFFIX))
            .otherwise(limit_text_within("content", MAX_MESSAGE_CHARS, TRUNCATED_SUFFIX)))


def compact_messages(messages: DataFrame, max_chars: int = MAX_PROMPT_CHARS, *, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Messages (conv_id, pos, role, content, has_tool_calls) that stay in the prompt, with their cut content.

    The leading system message stays. An assistant message with tool calls and the tool messages after it are one group.
    Groups are taken from the newest on while they fit; one that does not fit is skipped, the newest always stays.
    """
    cut = messages.withColumn("content", normalized_message())
    calls = (F.coalesce("has_tool_calls", F.lit(False)) & (F.col("role") == "assistant")).alias("calls")
    led = running(cut, ["conv_id"], F.when(F.col("role") != "tool", F.struct("pos", calls)), "_lead", how="max", position=F.col("pos"))
    placed = led.join(cut.groupBy("conv_id").agg(F.min("pos").alias("_first")), "conv_id")
    is_system = (F.col("role") == "system") & (F.col("pos") == F.col("_first"))
    group = F.when((F.col("role") == "tool") & F.col("_lead.calls"), F.col("_lead.pos")).otherwise(F.col("pos"))
    placed = placed.withColumn("_sys", is_system).withColumn("_group", group).drop("_lead", "_first")
    head = placed.groupBy("conv_id").agg(F.sum(F.when(F.col("_sys"), F.length("content")).otherwise(0)).alias("_used"), F.sum(F.length("content")).alias("_all"))
    groups = placed.where("NOT _sys").groupBy("conv_id", "_group").agg(F.sum(F.length("content")).alias("_size")).join(head, "conv_id")
    chosen = admit(groups.withColumn("_limit", F.lit(max_chars)), ["conv_id"], -F.col("_group").cast("long"), "_size", "_limit", used="_used",
                   first_always=True, fold_rows=fold_rows)
    kept = chosen.where(F.col("admitted") | (F.col("_all") <= max_chars)).select("conv_id", "_group")
    return placed.where("_sys").drop("_sys", "_group").unionByName(
        placed.where("NOT _sys").join(kept, ["conv_id", "_group"], "left_semi").drop("_sys", "_group"))
