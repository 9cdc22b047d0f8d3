"""Rule columns over a table of questions: intent, complexity, entities, variants, clarification.

The keyword lists are parameters. The defaults hold the Chinese lists and, beside them, lists in English, German,
French and Spanish, so that the rules also fire on text in those languages.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.text import STOP_WORDS_QUESTION, fingerprint, is_blank, jtrim, let


# --- fixed values -----------------------------------------------------------------------------
ENTITY = r"[A-Za-z][A-Za-z0-9_.-]{1,}|[一-龥]{2,12}"
PUNCTUATION = "[，。！？；：、,.!?;:]"
CONNECTIVES = "(?:以及|并且|同时|分别|然后|与|和|、)"
LEAD_IN = "^(?:请|请你|麻烦|帮我|帮忙|给我)+"
ACTION_VERB = "^(?:执行|创建|删除|修改|提交|发送)"
EMPTY_TARGETS = ("", "一下", "这个", "那个", "它", "吧")
MULTI_HOP_LENGTH, COMPLEX_LENGTH, MIN_PART, MAX_ENTITIES, MAX_VARIANTS = 18, 42, 4, 8, 4
FALLBACK_CONFIDENCE = 0.62
# ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class RuleLists:
    """Keywords per rule; matched in lower case, anywhere in the text."""

    summary: tuple[str, ...] = ("总结", "归纳", "摘要", "提炼")
    compare: tuple[str, ...] = ("对比", "比较", "区别", "差异", "优缺点")
    action: tuple[str, ...] = ("执行", "创建", "删除", "修改", "提交", "发送")
    multi_hop: tuple[str, ...] = ("分别", "结合", "关系", "导致", "影响")
    complex: tuple[str, ...] = ("以及", "并且", "同时", "分别", "然后")
    split: str = CONNECTIVES


CHINESE = RuleLists()
WITH_LATIN = RuleLists(
    summary=CHINESE.summary + ("summar", "zusammenfass", "résum", "resum"),
    compare=CHINESE.compare + ("compar", "vergleich", "difference", "versus"),
    action=CHINESE.action + ("delete", "create", "löschen", "supprimer", "borrar"),
    multi_hop=CHINESE.multi_hop + ("between", "zwischen", "entre", "effect"),
    complex=CHINESE.complex + (" and then ", " und dann ", " et puis ", " y luego "),
    split=r"(?:以及|并且|同时|分别|然后|与|和|、|\s(?:and|und|et|y)\s)",
)


def _any(value: Column, needles: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | value.contains(needle)
    return hit


def intent(query: Column | str, lists: RuleLists = WITH_LATIN) -> Column:
    value = F.col(query) if isinstance(query, str) else query
    lowered = F.lower(value)
    return (F.when(_any(lowered, lists.summary), "SUMMARY").when(_any(lowered, lists.compare), "COMPARE")
            .when(_any(lowered, lists.action), "ACTION")
            .when(_any(lowered, lists.multi_hop) & (F.length(value) > MULTI_HOP_LENGTH), "MULTI_HOP")
            .otherwise("KNOWLEDGE_QA"))


def is_complex(query: Column | str, intent_col: Column | str = "intent", lists: RuleLists = WITH_LATIN) -> Column:
    value = F.col(query) if isinstance(query, str) else query
    kind = F.col(intent_col) if isinstance(intent_col, str) else intent_col
    return kind.isin("COMPARE", "MULTI_HOP") | (F.length(value) > COMPLEX_LENGTH) | _any(value, lists.complex)


def _entities(value: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(value, F.lit(ENTITY), F.lit(0)), lambda e: ~e.isin(*STOP_WORDS_QUESTION)))


def entities(query: Column | str) -> Column:
    value = F.col(query) if isinstance(query, str) else query
    return F.slice(_entities(value), 1, MAX_ENTITIES)


def lexical_query(query: Column | str) -> Column:
    """Distinct terms without punctuation; the query itself when it has none."""
    value = F.col(query) if isinstance(query, str) else query
    joined = F.array_join(_entities(F.regexp_replace(value, PUNCTUATION, " ")), " ")
    return F.when(joined == "", value).otherwise(joined)


def sub_queries(query: Column | str, lists: RuleLists = WITH_LATIN) -> Column:
    value = F.col(query) if isinstance(query, str) else query
    parts = F.transform(F.split(value, lists.split), lambda p: jtrim(p))
    return F.filter(parts, lambda p: (F.length(p) >= MIN_PART) & (p != value))


def query_plans(queries: DataFrame, lists: RuleLists = WITH_LATIN) -> DataFrame:
    """Add intent, complexity, entities, lexical, parts, missing_slots to (query_id, text, ...)."""
    typed = (queries.withColumn("text", jtrim("text")).withColumn("intent", intent("text", lists)).withColumn("entities", entities("text"))
             .withColumn("lexical", lexical_query("text")))
    slots = missing_slots(F.col("text"), F.col("intent"), F.col("entities"))
    hard = is_complex("text", "intent", lists)
    return (typed.withColumn("complexity", F.when(hard, "COMPLEX").otherwise("SIMPLE"))
            .withColumn("parts", F.when(hard, sub_queries("text", lists)).otherwise(F.array().cast("array<string>")))
            .withColumn("missing_slots", slots).withColumn("confidence", F.lit(FALLBACK_CONFIDENCE)))


def missing_slots(text: Column, kind: Column, found: Column) -> Column:
    """What a question lacks before it can be answered: an action its target, a comparison its two sides."""
    tail = jtrim(F.regexp_replace(jtrim(F.regexp_replace(text, LEAD_IN, "")), ACTION_VERB, ""))
    return (F.when((kind == "ACTION") & tail.isin(*EMPTY_TARGETS), F.array(F.lit("actionTarget")))
            .when((kind == "COMPARE") & (F.size(found) < 2), F.array(F.lit("comparisonTargets")))
            .otherwise(F.array().cast("array<string>")))


def variant_array(limit: int = MAX_VARIANTS) -> Column:
    """Variants of a plan row: original, lexical, parts; each spelling once, first kept, at most ``limit``."""
    def variant(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("variant_type"), value.alias("variant"), fingerprint(value).alias("fp"))

    listed = F.concat(F.array(variant("ORIGINAL", F.col("text")), variant("LEXICAL", F.col("lexical"))),
                      F.transform("parts", lambda p: variant("DECOMPOSED", p)))

    def distinct(all_):
        keys = F.transform(all_, lambda v: v["fp"])
        return F.slice(F.filter(all_, lambda v, i: F.array_position(keys, v["fp"]) == i + 1), 1, limit)

    return let(F.filter(listed, lambda v: v["fp"] != ""), distinct)


def query_variants(plans: DataFrame, limit: int = MAX_VARIANTS) -> DataFrame:
    """(plan columns, variant_no, variant_type, variant, fp), one row per variant. Works inside the row: no shuffle."""
    kept = [c for c in plans.columns if c not in ("parts", "lexical")]
    rows = (plans.withColumn("_kept", variant_array(limit)).select(*kept, F.posexplode_outer("_kept").alias("_i", "_v"))
            .where("_i IS NOT NULL"))
    return rows.select(*kept, (F.col("_i") + 1).alias("variant_no"), "_v.*")


PLAN_SCHEMA = ("intent string, complexity string, needsRetrieval boolean, entities array<string>, constraints array<string>, "
               "knownSlots map<string,string>, missingSlots array<string>, clarificationQuestion string, "
               "variants array<struct<type:string,query:string,purpose:string>>, confidence double")


def parse_plans(outputs: DataFrame, text_col: str = "output") -> DataFrame:
    """Structured plan from planner text: the outermost braces, unknown enums to their default, blanks out, 0..1 confidence."""
    block = F.regexp_extract(text_col, r"(?s)\{.*\}", 0)
    plan = F.from_json(block, PLAN_SCHEMA, {"mode": "PERMISSIVE"})
    p = F.col("_plan")

    def one_of(value: Column, allowed: tuple[str, ...], default: str) -> Column:
        upper = F.upper(F.coalesce(value, F.lit("")))
        return F.when(upper.isin(*allowed), upper).otherwise(default)

    def texts(value: Column) -> Column:
        cleaned = F.filter(F.transform(value, lambda v: jtrim(v)), lambda v: v != "")
        return F.coalesce(cleaned, F.array().cast("array<string>"))

    return outputs.withColumn("_plan", plan).select(
        *outputs.columns,
        one_of(p["intent"], ("CHAT", "KNOWLEDGE_QA", "SUMMARY", "COMPARE", "ACTION", "MULTI_HOP"), "KNOWLEDGE_QA").alias("intent"),
        one_of(p["complexity"], ("SIMPLE", "COMPLEX"), "SIMPLE").alias("complexity"),
        texts(p["entities"]).alias("entities"), texts(p["missingSlots"]).alias("missing_slots"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(p["confidence"], F.lit(0.5)))).alias("confidence"),
        F.col("_plan").isNotNull().alias("parsed"))


def merge_slots(known: Column, missing: Column, answer: Column) -> Column:
    """Known slots plus the answer: one missing slot takes it whole, as many parts as slots fill them in order."""
    text = jtrim(answer)
    parts = F.transform(F.split(text, "[，,、;；]"), lambda p: jtrim(p))
    added = (F.when(F.size(missing) == 1, F.map_from_arrays(missing, F.array(text)))
             .when((F.size(missing) > 0) & (F.size(parts) == F.size(missing)), F.map_from_arrays(missing, parts))
             .otherwise(F.create_map(F.lit("clarificationAnswer"), text)))
    return F.map_from_entries(F.concat(
        F.map_entries(F.map_filter(known, lambda k, _: ~F.array_contains(F.map_keys(added), k))), F.map_entries(added)))


def _squeezed(value):
    if isinstance(value, dict):
        return {k: _squeezed(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_squeezed(v) for v in value]
    return re.sub(r"\s+", " ", value.strip("".join(map(chr, range(33))))) if isinstance(value, str) else value


def canonical(text: str | None) -> str:
    """JSON with keys sorted at every level, types kept, strings squeezed and escaped. Nothing is an empty object; no JSON stands as a string."""
    try:
        value = json.loads(text) if text and text.strip() else {}
    except ValueError:
        value = text
    return json.dumps(_squeezed(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def canonical_json(args: Column) -> Column:
    """``canonical`` by Arrow batches: no built-in rewrites strings inside nested objects."""
    return F.pandas_udf(lambda texts: pd.Series([canonical(t) for t in texts], dtype=object), "string")(args)


def action_fingerprint(tool: Column, args: Column) -> Column:
    """SHA-256 of tool and canonical JSON arguments."""
    return F.sha2(F.concat(jtrim(tool), F.lit("\n"), canonical_json(args)), 256)


# --- fixed values: failures and what to do about them -------------------------------------------
FAILURES = (
    ("RATE_LIMITED", True, "RETRY_WITH_BACKOFF"),
    ("TIMEOUT", True, "RETRY_WITH_SMALLER_SCOPE"),
    ("PERMISSION_DENIED", False, "REQUEST_PERMISSION"),
    ("NOT_FOUND", False, "CLARIFY_RESOURCE"),
    ("INVALID_ARGUMENT", False, "REWRITE_ARGUMENTS"),
    ("INTERNAL", False, "STOP_OR_FALLBACK"),
)
FAILOVER_CODES = (401, 403, 408, 429)
# ----------------------------------------------------------------------------------------------


def classify_failures(calls: DataFrame, kind: str = "failure") -> DataFrame:
    """Add error_type, retryable and suggested_action by failure kind; an unknown kind is INTERNAL."""
    known = [name for name, _, _ in FAILURES]
    error = F.when(F.col(kind).isin(*known), F.col(kind)).otherwise("INTERNAL")
    retry, action = None, None
    for name, flag, what in FAILURES:
        hit = F.col("error_type") == name
        retry = F.when(hit, flag) if retry is None else retry.when(hit, flag)
        action = F.when(hit, what) if action is None else action.when(hit, what)
    return calls.withColumn("error_type", error).withColumn("retryable", retry).withColumn("suggested_action", action)


def can_failover(status_code: Column) -> Column:
    return F.coalesce(status_code.isin(*FAILOVER_CODES) | (status_code >= 500), F.lit(False))


def lenient_timestamp(text: Column | str, end_of_range: bool = False) -> Column:
    """Day, hour, minute or full ISO text; at the end of a range the missing part is filled to its last second."""
    value = F.col(text) if isinstance(text, str) else text
    fill = {16: ":59", 13: ":59:59", 10: "T23:59:59"} if end_of_range else {16: ":00", 13: ":00:00", 10: "T00:00:00"}
    whole = value
    for length, rest in fill.items():
        whole = F.when(F.length(value) == length, F.concat(value, F.lit(rest))).otherwise(whole)
    return F.try_to_timestamp(whole)


def cents(price: Column | str) -> Column:
    """Price text to cents, halves down; null for blank text."""
    value = F.col(price) if isinstance(price, str) else price
    amount = F.nullif(F.trim(value), F.lit("")).cast("decimal(18,6)") * 100
    floor = F.floor(amount)
    return F.when(amount - floor > F.lit(0.5).cast("decimal(2,1)"), floor + 1).otherwise(floor).cast("long")


def yuan(amount: Column | str) -> Column:
    """Cents to text with no more decimals than needed."""
    value = F.col(amount) if isinstance(amount, str) else amount
    text = (value.cast("decimal(18,2)") / 100).cast("decimal(18,2)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"\.00$", ""), r"(\.\d)0$", "$1")


def discount_percent(discount: Column | str) -> Column:
    """Tenths text ("8.5") to percent (85), halves down; null for blank text."""
    tenths = F.trim(F.col(discount) if isinstance(discount, str) else discount).cast("decimal(18,6)") * 10
    return F.when(~is_blank(discount), F.ceil(tenths - F.lit("0.5").cast("decimal(2,1)")).cast("int"))


def percent_discount(percent: Column | str) -> Column:
    """Percent (85) to tenths text with one decimal ("8.5"); null stays null."""
    value = F.col(percent) if isinstance(percent, str) else percent
    return (value.cast("decimal(18,1)") / 10).cast("decimal(18,1)").cast("string")


def legal_price(price: Column | str) -> Column:
    return F.coalesce(cents(price) > 0, F.lit(False))


