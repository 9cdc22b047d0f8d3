"""Question to evidence for all questions at once: plan, recall, fuse, rerank, assemble parents, assess, and at most two corrective rounds.

Every stage leaves a trace row per question (counts in and out, status, details), and what did not go as planned a degradation row. A question whose plan needs no
retrieval, or all of them when retrieval is switched off, stops after its planning stage without an assessment.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.rules import query_variants
from corpuscope.functions.text import MATCHED_CHUNK_LENGTH, anchor, limit_text
from corpuscope.operators import fuse
from corpuscope.operators.evidence import MAX_ROUNDS, ConflictPhrases, assess, corrective_queries
from corpuscope.operators.postings import Postings
from corpuscope.session import cut_lineage, only_ids

TRACE = ["query_id", "round", "stage", "status", "n_in", "n_out", "details", "latency_ms"]


@dataclass
class Outcome:
    """Hits, assessment and refinement rounds of every question after its own last round; trace and degradations of all rounds.

    ``trace``: query_id, round, stage, status, n_in, n_out, details (``key=value`` joined by ``;``), latency_ms of the round's job (null where a stage shares the next one's).
    ``degradations``: query_id, round, reason.
    """

    hits: DataFrame
    assessments: DataFrame
    trace: DataFrame
    degradations: DataFrame


def as_evidence(hits: DataFrame, docs: DataFrame, files: DataFrame) -> DataFrame:
    """Hits with the four text columns that evidence looks at; the document itself is the only passage."""
    hits = cut_lineage(hits.select("query_id", "doc_id", "rank"))
    names = fuse.attach_names(hits, files)
    body = only_ids(docs.select("doc_id", "text"), hits, "doc_id")
    none = F.lit(None).cast("string")
    return names.join(body, "doc_id").select("query_id", "doc_id", "rank", "file_name", none.alias("anchor_text"), none.alias("matched"), "text")


def assembled(ranked: DataFrame, docs: DataFrame, files: DataFrame, children: DataFrame | None, parents: DataFrame | None, k: int) -> DataFrame:
    """Reranked hits as evidence: best child of every parent, the parent's text with its heading as anchor, the child's own text as match.

    ``children``: doc_id, parent_id (null: it stands for itself). ``parents``: parent_id, parent_text. Only texts of the hits and their parents move.
    """
    hits = ranked.select("query_id", F.col("doc_id").alias("child_id"), "rank")
    body = only_ids(docs.select("doc_id", "text"), ranked, "doc_id")
    if children is None:
        own = body.select(F.col("doc_id").alias("child_id"), "doc_id", F.lit(None).cast("bigint").alias("parent_id"), "text")
        texts = own.select("parent_id", F.lit(None).cast("string").alias("parent_text")).where("false")
    else:
        links = cut_lineage(only_ids(children.select("doc_id", "parent_id"), ranked, "doc_id"))
        own = body.join(links, "doc_id", "left").select(F.col("doc_id").alias("child_id"), "doc_id", "parent_id", "text")
        texts = only_ids(parents.select("parent_id", "parent_text"), links, "parent_id")
    own = cut_lineage(own)
    wide = fuse.assemble_parents(hits, own, texts, k)
    matched = own.select("child_id", limit_text("text", MATCHED_CHUNK_LENGTH).alias("matched"))
    named = fuse.attach_names(wide.join(matched, "child_id"), files)
    return named.select("query_id", "doc_id", "rank", "file_name", anchor("text").alias("anchor_text"), "matched", "text", "expanded", "n_candidates", "n_dropped")


def _details(*parts: tuple[str, Column]) -> Column:
    return F.concat_ws(";", *[F.concat(F.lit(f"{name}="), value.cast("string")) for name, value in parts])


def planning_rows(plans: DataFrame, variants: DataFrame) -> DataFrame:
    """The planning stage: one question in, its variants out."""
    made = variants.groupBy("query_id").agg(F.count("*").alias("n"))
    return plans.join(made, "query_id", "left").select(
        "query_id", F.lit(0).alias("round"), F.lit("QUERY_PLANNING").alias("stage"), F.lit("SUCCEEDED").alias("status"), F.lit(1).cast("long").alias("n_in"),
        F.coalesce("n", F.lit(0)).alias("n_out"), _details(("complexity", F.col("complexity")), ("intent", F.col("intent"))).alias("details"), F.lit(None).cast("long").alias("latency_ms"))


def stage_rows(who: DataFrame, variants: DataFrame, lists: DataFrame, all_lists: DataFrame, fused: DataFrame, ranked: DataFrame, hits: DataFrame, assessments: DataFrame,
               degraded: DataFrame, round_: int, recall_ms: int, rank_ms: int) -> DataFrame:
    """Trace of one round. Fusion takes ``all_lists``, those of earlier rounds too."""
    def per(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("query_id").agg(F.count("*").alias(name))

    base = who.select("query_id")
    for df, name in ((variants, "v"), (lists, "l"), (all_lists, "al"), (fused, "f"), (ranked, "r"), (hits, "a"), (degraded, "d")):
        base = base.join(per(df, name), "query_id", "left")
    channels = lists.groupBy("query_id", "channel", "query_type").agg(F.count("*").alias("n"))
    named = F.concat(F.col("channel"), F.lit(":"), F.col("query_type"), F.lit("="), F.col("n").cast("string"))
    channels = channels.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list(named)), ";").alias("channels"))
    widened = hits.groupBy("query_id").agg(F.count_if("expanded").alias("x"), F.max("n_dropped").alias("dropped"))
    judged = assessments.select("query_id", "status", F.size("covered").alias("c"), "confidence", "action")
    base = base.fillna(0).join(channels, "query_id", "left").join(widened, "query_id", "left").join(judged, "query_id", "left").fillna(0, ["x", "dropped"])
    suffix = f"_{round_}" if round_ else ""
    ok, round_of = F.lit("SUCCEEDED"), ("refinementRound", F.lit(round_))
    none = F.lit(None).cast("long")
    stages = (
        (f"CORRECTIVE_RECALL{suffix}" if round_ else "PARALLEL_RECALL", "v", "l", F.when(F.col("d") > 0, "DEGRADED").otherwise("SUCCEEDED"), F.coalesce("channels", F.lit("")), F.lit(recall_ms)),
        (f"RRF_FUSION{suffix}", "al", "f", ok, _details(("rankConstant", F.lit(fuse.RANK_CONSTANT)), round_of), none),
        (f"RERANK{suffix}", "f", "r", ok, _details(round_of, ("strategy", F.lit("HEURISTIC"))), F.lit(rank_ms)),
        (f"PARENT_CONTEXT_ASSEMBLY{suffix}", "r", "a", ok, _details(("deduplicatedChildren", F.col("dropped")), ("expandedParents", F.col("x")), round_of), none),
        (f"EVIDENCE_VERIFY{suffix}", "a", "c", F.coalesce("status", F.lit("SKIPPED")),
         _details(("action", F.col("action")), ("confidence", F.floor(F.col("confidence") * 10_000)), round_of), none))
    rows = F.array(*[F.struct(F.lit(n).alias("stage"), s.alias("status"), F.coalesce(F.col(i), F.lit(0)).cast("long").alias("n_in"), F.coalesce(F.col(o), F.lit(0)).cast("long").alias("n_out"),
                              d.alias("details"), ms.cast("long").alias("latency_ms")) for n, i, o, s, d, ms in stages])
    return base.select("query_id", F.lit(round_).alias("round"), F.explode(rows).alias("s")).select("query_id", "round", "s.*").select(*TRACE)


def _millis(since: float) -> int:
    return int(1000 * (time.monotonic() - since))


def retrieve(plans: DataFrame, docs: DataFrame, vectors: DataFrame | None, files: DataFrame, k: int, *, max_rounds: int = MAX_ROUNDS, index: Postings | None = None,
             children: DataFrame | None = None, parents: DataFrame | None = None, phrases: ConflictPhrases = ConflictPhrases(), enabled: bool = True) -> Outcome:
    """Run every question of ``plans`` (query_id, text, entities, intent, complexity, parts, lexical, aspects, user_id, user_tags[, embedding][, retrieval_required]).

    A plan without ``retrieval_required`` is retrieved for unless its intent is chat. The driver loop has at most ``max_rounds`` steps, whatever the number of questions; each
    handles all open questions in one plan and is cut off from the ones before it in the shared checkpoint folder.
    """
    needed = F.col("retrieval_required") if "retrieval_required" in plans.columns else F.col("intent") != "CHAT"
    variants = query_variants(plans.drop("embedding")).select("query_id", "variant_no", "variant_type", "variant", "fp")
    trace = planning_rows(plans, variants)
    plans = plans.where(F.coalesce(needed, F.lit(True)) & F.lit(enabled))
    variants = cut_lineage(variants.join(plans.select("query_id"), "query_id", "left_semi"))
    identity = plans.select("query_id", "user_id", "user_tags", *(["embedding"] if "embedding" in plans.columns else []))

    def recall(rows: DataFrame) -> tuple[DataFrame, int]:
        since = time.monotonic()
        asked = rows.select("query_id", "variant_no", "variant_type", F.col("variant").alias("text")).join(identity, "query_id")
        return cut_lineage(fuse.recall_round(asked, index or docs, vectors, k)), _millis(since)

    def unable(rows: DataFrame, round_: int) -> DataFrame:
        """The vector channel cannot be asked without an embedding."""
        blind = identity.where("embedding IS NULL") if vectors is not None and "embedding" in identity.columns else identity.where(F.lit(vectors is None or "embedding" not in identity.columns))
        reason = F.concat(F.lit("VECTOR:"), F.col("variant_type"), F.lit(f":{round_} -> no embedding"))
        return rows.join(blind.select("query_id"), "query_id", "left_semi").select("query_id", F.lit(round_).alias("round"), reason.alias("reason"))

    def judge(lists: DataFrame, who: DataFrame, round_: int):
        since = time.monotonic()
        fused = cut_lineage(fuse.rrf(lists, fuse.FUSION_LIMIT))
        ranked = cut_lineage(fuse.heuristic_rerank(fused, who.select("query_id", "text"), docs, k))
        hits = cut_lineage(assembled(ranked, docs, files, children, parents, k))
        judged = cut_lineage(assess(who, hits, round_, phrases=phrases, max_rounds=max_rounds))
        return fused, ranked, hits, judged, _millis(since)

    lists, recall_ms = recall(variants)
    executed = variants.select("query_id", "fp")
    degradations = unable(variants, 0)
    fused, ranked, hits, assessments, rank_ms = judge(lists, plans, 0)
    trace = trace.unionByName(stage_rows(plans, variants, lists, lists, fused, ranked, hits, assessments, degradations, 0, recall_ms, rank_ms))
    open_ = assessments
    for round_ in range(1, max_rounds + 1):
        open_ = cut_lineage(open_.where(F.col("status").isin("PARTIAL", "INSUFFICIENT")))
        refined = cut_lineage(corrective_queries(plans, open_, executed))
        touched = cut_lineage(refined.select("query_id").distinct())
        skipped = open_.join(touched, "query_id", "left_anti")
        degradations = degradations.unionByName(skipped.select("query_id", F.lit(round_).alias("round"), F.lit("EVIDENCE_REFINE_SKIPPED: no new query").alias("reason")))
        if touched.isEmpty():
            break
        who = plans.join(touched, "query_id", "left_semi")
        new, recall_ms = recall(refined)
        lists = lists.unionByName(new.withColumn("variant_no", F.col("variant_no") + 10 * round_))
        executed = executed.unionByName(refined.select("query_id", "fp"))
        blind = unable(refined, round_)
        degradations = degradations.unionByName(blind)
        mine = lists.join(touched, "query_id", "left_semi")
        fused, ranked, again, judged, rank_ms = judge(mine, who, round_)
        trace = trace.unionByName(stage_rows(who, refined, new, mine, fused, ranked, again, judged, blind, round_, recall_ms, rank_ms))
        hits = hits.join(touched, "query_id", "left_anti").unionByName(again)
        assessments = cut_lineage(assessments.join(touched, "query_id", "left_anti").unionByName(judged))
        # a question goes on only while its evidence changes
        changed = judged.join(open_.select("query_id", F.col("signature").alias("_before")), "query_id")
        stopped = changed.where("signature = _before").select("query_id", F.lit(round_).alias("round"), F.lit("EVIDENCE_REFINE_STOPPED: same evidence as before").alias("reason"))
        degradations = degradations.unionByName(stopped)
        open_ = changed.where("signature <> _before").drop("_before")
    return Outcome(hits, assessments, trace, degradations)
