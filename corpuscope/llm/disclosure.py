"""Personal data: base patterns, and terms whose co-occurrence in the corpus discloses a protected entity.

Base kinds are matched leftmost and without overlap, kind by kind, and checked (address parts, Luhn, digit counts). The
values found are the protected entities. Information-theoretic sanitisation then asks of every word in a line beside an entity how strongly
it points to it: with ``both`` lines that have word and entity, ``own`` lines that have the word and ``with`` lines that have the entity, out
of ``all`` lines, the share ``both / own`` and the pointwise mutual information ``log2(both * all / (own * with))``. A word of any length is disclosing
when, in at least ``LEAST_CONTEXTS`` different surroundings of the entity (so that copies count once), the share is ``LEAST_SHARE`` or more, the information
is ``LEAST_RELATIVE`` or more of the most it can be for this entity, ``log2(all / with)``, and the information of all common lines together is no chance: ``LEAST_BITS`` for
each of the ``LEAST_CONTEXTS``, or ``log2(all)`` where that is less. So an entity on many lines needs more common lines, but none is too frequent for a term. The
occurrences of such a word become spans of the kind ``term``. Spans are generalised to the name of their kind, or removed.

The patterns are the plain ones, written with possessive repeats and a test for the start of a run, which match the same spans
in linear time. Positions are code points.

Cases: a null text counts as empty and has no spans; rows equal in doc_id and text get equal results; a match never spans lines;
entities are compared in lower case; ties in positions are ordered by kind; an empty table gives no rows; columns of other names are left out, whatever they are called. All counts are over all documents.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.base import keyed, salted_join, small_enough
from corpuscope.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
LEAST_SHARE, LEAST_BITS, LEAST_CONTEXTS, AROUND = 0.5, 8.0, 3, 30
#: what eight bits are of the nine that an entity needs for them at a share of a half
LEAST_RELATIVE = 8 / 9
TERM = r"\p{L}++"
SPAN = "array<struct<kind:int,start:int,end:int>>"

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERN = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: what a text must have for a kind to be looked for at all
HINT = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?+[0-9]){15}", "phone": r"\+[0-9]"}
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _placed(number: int, kept, text: Column, pattern: Column) -> Column:
    """Spans of a pattern's matches that pass ``kept``: gaps and matches alternate, and their lengths add up to the positions."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def place(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        span = F.array(F.struct(F.lit(number).alias("kind"), start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(kept(pair["hit"]), F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

    pairs = F.arrays_zip(found.alias("hit"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"))
    return F.aggregate(pairs, zero, place)["out"]


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by kind and then start."""
    none = F.array().cast(SPAN)
    parts = [F.when(text.rlike(HINT[k]), _placed(i, lambda v, k=k: _valid(k, v), text, F.lit(PATTERN[k]))).otherwise(none) for i, k in enumerate(KINDS)]
    return F.concat(*parts)


def _plain(text: Column) -> Column:
    """The text with base matches blanked, so that no piece of an entity counts as a word."""
    for kind in ("email", "phone", "card", "ip"):
        text = F.regexp_replace(text, PATTERN[kind], " ")
    return text


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def disclosing_terms(docs: DataFrame, share: float = LEAST_SHARE, bits: float = LEAST_BITS, contexts: int = LEAST_CONTEXTS) -> DataFrame:
    """``term`` of every word that discloses some entity."""
    lines = keyed(docs).select(F.explode_outer(F.split("_text", "\n")).alias("line"))
    hint = F.col("line").rlike("|".join(f"(?:{HINT[k]})" for k in KINDS))
    held = lines.where(hint).withColumn("spans", base_spans(F.col("line"))).where(F.size("spans") > 0)
    near = held.select("line", _terms(_plain(F.col("line"))).alias("terms"), F.explode_outer("spans").alias("s"))
    value = F.lower(F.substring(F.col("line"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")))
    begin = F.greatest(F.col("s.start") - AROUND, F.lit(0))
    around = F.xxhash64(F.substring(F.col("line"), begin + 1, F.col("s.end") - begin + AROUND))
    pairs = near.select(F.concat_ws(":", "s.kind", value).alias("entity"), around.alias("around"), "terms")
    entities = cut_lineage(pairs.groupBy("entity").agg(F.count("*").alias("with"))
                           .where(F.col("with") >= contexts).select("entity", "with"))
    # an entity in a common footer is on a large share of all lines
    met = salted_join(pairs, entities, ["entity"], F.xxhash64("around", F.size("terms"), F.array_join("terms", " "))).select("entity", "with", "around", F.explode_outer("terms").alias("term")).where("term IS NOT NULL")
    by_context = met.groupBy("entity", "term", "with", "around").agg(F.count("*").alias("n"))
    strong = cut_lineage(by_context.groupBy("entity", "term", "with").agg(F.sum("n").alias("both"), F.count("*").alias("contexts"))
                         .where(F.col("contexts") >= contexts))
    every = lines.select(_terms(_plain(F.col("line"))).alias("terms")).select(F.explode_outer("terms").alias("term"))
    # words are counted before they meet the candidates: common words are candidates too, and would pass with every occurrence
    own = every.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("own")).join(strong.select("term").distinct(), "term")
    total = keyed(docs).agg(F.sum(F.size(F.split("_text", "\n"))).alias("all"))
    judged = strong.join(own, "term").withColumn("_one", F.lit(0)).join(F.broadcast(total.withColumn("_one", F.lit(0))), "_one")  # one row
    told = F.log2(F.col("both") * F.col("all") / (F.col("own") * F.col("with")))
    relative = told >= LEAST_RELATIVE * F.log2(F.col("all") / F.col("with"))
    certain = told * F.col("both") >= F.least(F.lit(bits * contexts), F.log2("all"))
    return judged.where((F.col("both") >= share * F.col("own")) & relative & certain).select("term").distinct()


def find(docs: DataFrame, share: float = LEAST_SHARE, bits: float = LEAST_BITS, contexts: int = LEAST_CONTEXTS) -> DataFrame:
    """Per row: ``doc_id``, ``_key``, ``text`` and ``spans`` (kind number, start, end), the number after the base kinds being ``term``."""
    rows = keyed(docs)
    terms = cut_lineage(disclosing_terms(docs, share, bits, contexts))
    words = rows.select("_key", F.explode_outer(_terms(F.col("_text"))).alias("term")).where("term IS NOT NULL")
    met = words.join(F.broadcast(terms), "term") if small_enough(terms) else salted_join(words, terms, ["term"], F.xxhash64("_key"))
    per_doc = met.groupBy("_key").agg(F.array_join(F.sort_array(F.collect_set("term")), "|").alias("_terms"))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.col("_terms"), F.lit(r")(?!\p{L})"))
    own = F.when(F.col("_terms").isNotNull(), _placed(len(KINDS), lambda v: F.lit(True), F.col("_text"), pattern)).otherwise(F.array().cast(SPAN))
    return rows.join(per_doc, "_key", "left").select(
        F.col("_id").alias("doc_id"), "_key", F.col("_text").alias("text"), F.concat(base_spans(F.col("_text")), own).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column, generalise: bool = True) -> Column:
    """The text with every span replaced by the name of its kind in brackets, or removed; of overlapping spans the first counts."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "term")])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        name = F.when(s["start"] >= state["at"], F.get(names, s["kind"])).otherwise(F.lit("")) if generalise else F.lit("")
        piece = F.concat(F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0))), name)
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], F.array(piece)).alias("out"))

    def end(state: Column) -> Column:
        return F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"] + 1, F.length(text)))

    return F.aggregate(order, zero, step, end)
