"""How well the hits of a query cover it: aspects, coverage, status, conflicts, signature, corrective queries.

Every step works on one row per (query, hit) and combines them per query; a query has at most the final top-k hits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.rules import variant_array
from corpuscope.functions.text import evidence_terms, fingerprint, jtrim
from corpuscope.operators.access import first_rows

# --- fixed values -----------------------------------------------------------------------------
MIN_RESULTS, QUERY_COVERAGE, ASPECT_COVERAGE, COMPLEX_ASPECT_COVERAGE = 2, 0.25, 0.5, 0.75
MAX_ROUNDS, MAX_REFINED, MAX_ASPECT_ENTITIES = 2, 3, 6
VOLUME_WEIGHT, QUERY_WEIGHT, ASPECT_WEIGHT, VOLUME_FULL, EMPTY_CONFIDENCE = 0.25, 0.4, 0.35, 4, 0.95
TERMINAL_REASONS = {"ANSWER": "ANSWERED", "ANSWER_WITH_CONFLICTS": "CONFLICTED", "PARTIAL_ANSWER": "PARTIAL", "ABSTAIN": "INSUFFICIENT_EVIDENCE"}
# ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ConflictPhrases:
    """A yes/no question is one that has a ``question`` phrase; evidence supports or rejects by phrase."""

    question: tuple[str, ...] = ("是否",)
    support: tuple[str, ...] = ("支持",)
    reject: tuple[str, ...] = ("不支持", "禁止")
    against: tuple[str, ...] = ("不支持",)


def _any(value: Column, needles: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | value.contains(needle)
    return hit


def required_aspects(plans: DataFrame) -> DataFrame:
    """Add ``aspects``: decomposed variants, else up to six entities of a comparison or multi-hop question, else the query."""
    parts = F.transform(F.filter(variant_array(), lambda v: v["variant_type"] == "DECOMPOSED"), lambda v: jtrim(v["variant"]))
    named = F.when(F.col("intent").isin("COMPARE", "MULTI_HOP"), F.slice("entities", 1, MAX_ASPECT_ENTITIES)).otherwise(F.array().cast("array<string>"))
    whole = F.when(F.col("text") != "", F.array("text")).otherwise(F.array().cast("array<string>"))
    return (plans.withColumn("_parts", F.array_distinct(parts)).withColumn("_named", F.array_distinct(named))
            .withColumn("aspects", F.when(F.size("_parts") > 0, F.col("_parts")).when(F.size("_named") > 0, F.col("_named")).otherwise(whole))
            .drop("_parts", "_named"))


def searchable_text() -> Column:
    """File name, anchor, matched passage and text of a hit; absent columns are given as null."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("file_name", "anchor_text", "matched", "text")])


def coverage(asked: DataFrame, hits: DataFrame, phrases: ConflictPhrases = ConflictPhrases()) -> DataFrame:
    """One row per query: n_hits, query_coverage, aspect_scores (best single hit per aspect), doc_ids, conflict.

    ``asked``: query_id, text, aspects. ``hits``: query_id, doc_id, file_name, anchor_text, matched, text.
    """
    wanted = asked.select("query_id", F.col("text").alias("_query"), evidence_terms("text").alias("_q"),
                          F.transform("aspects", lambda a: evidence_terms(a)).alias("_a"))
    found = hits.select("query_id", "doc_id", searchable_text().alias("_body"))
    rows = wanted.join(found, "query_id", "left").withColumn("_d", F.when(F.col("doc_id").isNotNull(), evidence_terms("_body")))

    def share(aspect):
        hit = F.size(F.array_intersect(aspect, F.col("_d")))
        return F.when(F.size(aspect) == 0, 0.0).otherwise(F.coalesce(hit / F.size(aspect), F.lit(0.0)))

    body = F.lower("_body")
    supports = F.coalesce(_any(body, phrases.support) & ~_any(body, phrases.against), F.lit(False))
    rejects = F.coalesce(_any(body, phrases.reject), F.lit(False))
    scored = rows.select("query_id", "doc_id", "_query", "_q", F.transform("_a", share).alias("_s"), F.array_intersect("_q", "_d").alias("_f"),
                         supports.alias("_yes"), rejects.alias("_no"))
    grouped = scored.groupBy("query_id").agg(
        F.count("doc_id").alias("n_hits"), F.first("_query").alias("_query"), F.size(F.first("_q")).alias("_n"),
        F.size(F.array_distinct(F.flatten(F.collect_list("_f")))).alias("_found"), F.collect_list("_s").alias("_ss"), F.size(F.first("_s")).alias("_k"),
        F.sort_array(F.collect_list(F.col("doc_id").cast("string"))).alias("doc_ids"), F.bool_or("_yes").alias("_yes"), F.bool_or("_no").alias("_no"))
    index = F.when(F.col("_k") > 0, F.sequence(F.lit(0), F.col("_k") - 1)).otherwise(F.array().cast("array<int>"))
    best = F.transform(index, lambda i: F.array_max(F.transform("_ss", lambda s: F.get(s, i))))
    conflict = _any(F.col("_query"), phrases.question) & (F.col("n_hits") >= 2) & F.col("_yes") & F.col("_no")
    return grouped.select("query_id", "n_hits", F.when(F.col("_n") == 0, 0.0).otherwise(F.col("_found") / F.col("_n")).alias("query_coverage"),
                          best.alias("aspect_scores"), "doc_ids", conflict.alias("conflict"))


def assess(asked: DataFrame, hits: DataFrame, refinement_round: int | Column = 0, *, phrases: ConflictPhrases = ConflictPhrases(),
           max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(query_id, status, confidence, covered, missing, n_hits, query_coverage, aspect_coverage, action, signature).

    ``asked`` carries query_id, text, aspects, intent, complexity.
    """
    seen = coverage(asked, hits, phrases)
    j = asked.select("query_id", "aspects", "intent", "complexity").join(seen, "query_id")
    good = lambda keep: F.filter("aspects", lambda a, i: (F.get("aspect_scores", i) >= ASPECT_COVERAGE) == F.lit(keep))
    j = j.withColumn("covered", good(True)).withColumn("missing", good(False)).withColumn(
        "aspect_coverage", F.when(F.size("aspects") == 0, F.col("query_coverage")).otherwise(F.size("covered") / F.size("aspects")))
    hard = (F.col("complexity") == "COMPLEX") | F.col("intent").isin("COMPARE", "MULTI_HOP")
    enough = ((F.col("n_hits") >= MIN_RESULTS) & (F.col("query_coverage") >= QUERY_COVERAGE) & (~hard | (F.col("aspect_coverage") >= COMPLEX_ASPECT_COVERAGE)))
    status = (F.when(F.col("conflict"), "CONFLICTED").when(F.col("n_hits") == 0, "INSUFFICIENT").when(enough, "SUFFICIENT")
              .when((F.col("query_coverage") > 0) | (F.col("aspect_coverage") > 0), "PARTIAL").otherwise("INSUFFICIENT"))
    base = VOLUME_WEIGHT * F.least(F.lit(1.0), F.col("n_hits") / VOLUME_FULL) + QUERY_WEIGHT * F.col("query_coverage") + ASPECT_WEIGHT * F.col("aspect_coverage")
    confidence = F.when((F.col("status") == "INSUFFICIENT") & (F.col("n_hits") == 0), EMPTY_CONFIDENCE).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)))
    done = refinement_round if isinstance(refinement_round, Column) else F.lit(refinement_round)
    action = (F.when(F.col("status") == "SUFFICIENT", "ANSWER").when(F.col("status") == "CONFLICTED", "ANSWER_WITH_CONFLICTS")
              .when(done < max_rounds, "REFINE_RETRIEVAL").when(F.col("n_hits") == 0, "ABSTAIN").otherwise("PARTIAL_ANSWER"))
    signature = F.sha2(F.concat_ws("|", "status", F.array_join("doc_ids", ","), F.array_join(F.array_sort("covered"), ",")), 256)
    return (j.withColumn("status", status).withColumn("confidence", F.round(confidence, 9)).withColumn("action", action)
            .withColumn("signature", signature).withColumn("round", done)
            .select("query_id", "status", "confidence", "covered", "missing", "n_hits", "query_coverage", "aspect_coverage", "action", "signature", "round"))


def terminal_reason(action: Column) -> Column:
    out = None
    for name, reason in TERMINAL_REASONS.items():
        out = F.when(action == name, reason) if out is None else out.when(action == name, reason)
    return out


def corrective_queries(asked: DataFrame, assessments: DataFrame, executed: DataFrame, n: int = MAX_REFINED) -> DataFrame:
    """(query_id, variant_no, variant_type, variant, fp) to run next: missing aspects, all of them joined, else the constrained query.

    ``executed``: (query_id, fp) of everything run before.
    """
    j = asked.select("query_id", "text", "entities").join(assessments.select("query_id", "missing"), "query_id")
    each = F.transform("missing", lambda m: F.struct(F.lit("DECOMPOSED").alias("variant_type"), m.alias("variant")))
    joined = F.struct(F.lit("LEXICAL").alias("variant_type"), F.array_join("missing", " ").alias("variant"))
    whole = F.struct(F.lit("SEMANTIC").alias("variant_type"), F.array_join(F.concat("entities", F.array("text")), " ").alias("variant"))
    wanted = F.when(F.size("missing") > 0, F.concat(each, F.array(joined))).otherwise(F.array(whole))
    rows = (j.select("query_id", F.posexplode_outer(wanted).alias("_i", "_v")).where("_i IS NOT NULL").select("query_id", "_i", "_v.*")
            .withColumn("fp", fingerprint("variant")).where("fp <> ''"))
    once = first_rows(rows, ["query_id", "fp"], [F.asc("_i")])
    fresh = once.join(executed.select("query_id", "fp").distinct(), ["query_id", "fp"], "left_anti")
    return first_rows(fresh, ["query_id"], [F.asc("_i")], n, "variant_no").select("query_id", "variant_no", "variant_type", "variant", "fp")
