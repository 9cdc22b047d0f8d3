"""Question rules, classification, fingerprints, redaction and other projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.functions import rules as R
from corpuscope.functions import text as X
from corpuscope.plans import fragments as sql
from corpuscope.plans.registry import query
from corpuscope.session import spread

L = R.WITH_LATIN


def _any(c, needles):
    return "(" + " OR ".join(f"contains({c}, '{n}')" for n in needles) + ")"


_TRIM = r"regexp_replace({c}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
_SQUEEZE = r"trim(regexp_replace({c}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"
_INTENT = f"""CASE WHEN {_any('lower(text)', L.summary)} THEN 'SUMMARY' WHEN {_any('lower(text)', L.compare)} THEN 'COMPARE'
    WHEN {_any('lower(text)', L.action)} THEN 'ACTION' WHEN {_any('lower(text)', L.multi_hop)} AND length(text) > 18 THEN 'MULTI_HOP'
    ELSE 'KNOWLEDGE_QA' END"""
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS_QUESTION)


def _distinct_in_order(expr):
    """DuckDB's list_distinct does not keep the order."""
    return f"list_filter({expr}, lambda e, i: list_position({expr}, e) = i)"


def _found(c):
    return f"list_filter(regexp_extract_all({c}, '{R.ENTITY}'), lambda e: e NOT IN ({_STOP}))"


# the questions of every turn and benchmark text together: many rows, both short and long
def plan_sql(source):
    """Common table expressions ending in ``plan`` over the (query_id, text) rows of ``source``."""
    return f"""qs AS (SELECT query_id, {_TRIM.format(c='text')} AS text FROM ({source})),
    q1 AS (SELECT *, {_INTENT} AS intent, {_found('text')} AS fe, {_found("regexp_replace(text, '" + R.PUNCTUATION + "', ' ', 'g')")} AS fl FROM qs),
    q2 AS (SELECT *, {_distinct_in_order('fe')}[1:8] AS entities, {_distinct_in_order('fl')} AS ll,
      intent IN ('COMPARE', 'MULTI_HOP') OR length(text) > 42 OR {_any('text', L.complex)} AS hard FROM q1),
    plan AS (SELECT query_id, text, intent, entities, CASE WHEN len(ll) = 0 THEN text ELSE array_to_string(ll, ' ') END AS lexical,
      CASE WHEN hard THEN 'COMPLEX' ELSE 'SIMPLE' END AS complexity,
      CASE WHEN hard THEN list_filter(list_transform(regexp_split_to_array(text, '{L.split}'), lambda p: {_TRIM.format(c='p')}),
        lambda p: length(p) >= 4 AND p <> text) ELSE [] END AS parts FROM q2)"""


# the questions of every turn and benchmark text together: many rows, both short and long
PLAN = plan_sql("SELECT item_id AS query_id, text FROM benchmark UNION ALL SELECT 1000000 + conv_id * 100 + pos, content FROM messages")


def questions(t):
    of_chat = t.messages.select((F.lit(1000000) + F.col("conv_id") * 100 + F.col("pos")).alias("query_id"), F.col("content").alias("text"))
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text").unionByName(of_chat)


def plans(t):
    return R.query_plans(questions(t))


@query("c01_intent", f"WITH {PLAN} SELECT query_id, intent FROM plan")
def _intent(t):
    return plans(t).select("query_id", "intent")


@query("c02_complexity", f"WITH {PLAN} SELECT query_id, complexity FROM plan")
def _complexity(t):
    return plans(t).select("query_id", "complexity")


@query("c03_entities", f"WITH {PLAN} SELECT query_id, array_to_string(entities, '|') AS entities FROM plan")
def _entities(t):
    return plans(t).select("query_id", F.array_join("entities", "|").alias("entities"))


@query("c04_lexical_variant", f"WITH {PLAN} SELECT query_id, lexical FROM plan")
def _lexical(t):
    return plans(t).select("query_id", "lexical")


@query("c05_decomposition", f"WITH {PLAN} SELECT query_id, len(parts) AS n_parts, array_to_string(parts, '|') AS parts FROM plan")
def _parts(t):
    return plans(t).select("query_id", F.size("parts").alias("n_parts"), F.array_join("parts", "|").alias("parts"))


def variants_sql(plan):
    return f"""{plan}, v1 AS (SELECT query_id, 1 AS o, 'ORIGINAL' AS variant_type, text AS variant FROM plan
      UNION ALL SELECT query_id, 2, 'LEXICAL', lexical FROM plan
      UNION ALL SELECT query_id, 2 + unnest(range(1, len(parts) + 1)), 'DECOMPOSED', unnest(parts) FROM plan),
    v2 AS (SELECT *, lower({_SQUEEZE.format(c='variant')}) AS fp FROM v1),
    v3 AS (SELECT *, row_number() OVER (PARTITION BY query_id, fp ORDER BY o) AS first FROM v2 WHERE fp <> ''),
    variants AS (SELECT * FROM (SELECT query_id, variant_type, variant, fp, row_number() OVER (PARTITION BY query_id ORDER BY o) AS variant_no
      FROM v3 WHERE first = 1) WHERE variant_no <= 4)"""


VARIANTS = variants_sql(PLAN)


@query("c06_query_variants", f"WITH {VARIANTS} SELECT query_id, variant_no, variant_type, variant FROM variants")
def _variants(t):
    return R.query_variants(plans(t)).select("query_id", "variant_no", "variant_type", "variant")


@query("c07_clarification", f"""WITH {PLAN}, tail AS (SELECT *, {_TRIM.format(c="regexp_replace(" + _TRIM.format(c="regexp_replace(text, '" + R.LEAD_IN + "', '')") + ", '" + R.ACTION_VERB + "', '')")} AS rest FROM plan)
    SELECT query_id, CASE WHEN intent = 'ACTION' AND rest IN ('', '一下', '这个', '那个', '它', '吧') THEN 'actionTarget'
      WHEN intent = 'COMPARE' AND len(entities) < 2 THEN 'comparisonTargets' ELSE '' END AS missing FROM tail""")
def _clarify(t):
    return plans(t).select("query_id", F.array_join("missing_slots", ",").alias("missing"))


@query("c08_structured_plan", """SELECT event_id, CASE WHEN event_type = 'error' THEN 'KNOWLEDGE_QA' WHEN event_type = 'view' THEN 'COMPARE' WHEN event_type = 'click'
      THEN 'SUMMARY' ELSE 'KNOWLEDGE_QA' END AS intent, CASE WHEN event_type = 'error' THEN 0.5 ELSE least(1.0::DOUBLE, value / 100) END AS confidence,
    CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS entities, event_type <> 'error' AS parsed FROM events""")
def _plans(t):
    kind = F.when(F.col("event_type") == "view", "compare").when(F.col("event_type") == "click", "Summary").otherwise("other")
    body = F.concat(F.lit('Plan: {"intent": "'), kind, F.lit('", "entities": [" '), F.col("event_type"), F.lit(' ", " "], "confidence": '),
                    (F.col("value") / 100).cast("string"), F.lit("} done"))
    outputs = t.events.select("event_id", F.when(F.col("event_type") == "error", F.lit("no plan")).otherwise(body).alias("output"))
    return R.parse_plans(outputs).select("event_id", "intent", "confidence", F.array_join("entities", "|").alias("entities"),
                                         F.col("output").contains("{").alias("parsed"))


@query("c09_slot_merge", r"""WITH a AS (SELECT conv_id, pos, content, CAST(conv_id % 3 AS INT) AS n, regexp_replace(content, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS ans,
      list_transform(regexp_split_to_array(regexp_replace(content, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '[，,、;；]'), lambda p: regexp_replace(p, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')) AS ps FROM messages)
    SELECT conv_id, pos, CASE WHEN n = 1 THEN 'scope=' || ans WHEN n = 2 AND len(ps) = 2 THEN 'period=' || ps[2] || '|scope=' || ps[1]
      ELSE 'clarificationAnswer=' || ans || '|scope=old' END AS slots FROM a""")
def _slots(t):
    n = F.col("conv_id") % 3
    missing = F.when(n == 1, F.array(F.lit("scope"))).when(n == 2, F.array(F.lit("scope"), F.lit("period"))).otherwise(F.array().cast("array<string>"))
    merged = R.merge_slots(F.create_map(F.lit("scope"), F.lit("old")), missing, F.col("content"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return t.messages.withColumn("m", merged).select("conv_id", "pos", text.alias("slots"))


@query("c11_query_fingerprint", f"SELECT conv_id, pos, lower({_SQUEEZE.format(c='content')}) AS fingerprint FROM messages")
def _fingerprint(t):
    return t.messages.select("conv_id", "pos", X.fingerprint("content").alias("fingerprint"))


_NESTED = r'{"z": {"b": [1, "x  y", null], "a": true}, "q": "say \"hi\"\n there", "k": '


@query("c12_action_fingerprint", r"""SELECT event_id, sha256(event_type || chr(10) || CASE CAST(event_id % 3 AS INT) WHEN 0 THEN '{"k":' || n || ',"source":"a b"}'
      WHEN 1 THEN '{"k":' || n || ',"q":"say \"hi\" there","z":{"a":true,"b":[1,"x y",null]}}' ELSE '[' || n || ',{"e":"\\","k":"1"}]' END) AS fingerprint
    FROM (SELECT event_id, event_type, regexp_extract(props, '[0-9]+', 0) AS n FROM events)""")
def _action(t):
    # flat, nested and listed arguments, with quotes, escapes and spaces in their strings
    n = F.regexp_extract("props", "[0-9]+", 0)
    args = (F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"source": " a  b ", "k": '), n, F.lit("}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit(_NESTED), n, F.lit("}")))
            .otherwise(F.concat(F.lit("["), n, F.lit(r', {"k": " 1 ", "e": "\\"}]'))))
    return t.events.select("event_id", R.action_fingerprint(F.col("event_type"), args).alias("fingerprint"))


@query("c13_term_sets", f"""SELECT doc_id, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9一-龥]+'), lambda t: length(t) > 1))) AS rerank_terms,
    len(list_distinct(list_filter({sql.tokens('text')}, lambda w: w NOT IN ({', '.join("'" + w + "'" for w in X.STOP_WORDS)})))) AS evidence_terms,
    len(list_distinct({sql.tokens('text')})) AS memory_terms FROM documents""")
def _terms(t):
    return spread(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", F.size(X.rerank_terms("text")).alias("rerank_terms"), F.size(X.evidence_terms("text")).alias("evidence_terms"),
                              F.size(X.memory_terms("text")).alias("memory_terms"))


def _category(c):
    return "CASE " + " ".join(f"WHEN {_any(f'lower({c})', ns)} THEN '{n}'" for n, ns in X.ERROR_CATEGORIES) + " ELSE 'UNKNOWN' END"


_WS = r"[^\t\n\x0B\f\r ]"
_MASKED = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(tx, '(?i)https?://{_WS}+', '[provider-endpoint]', 'g'),
    '(?i)bearer[\t\n\x0B\f\r ]+[a-z0-9._~+/=-]+', 'Bearer [redacted]', 'g'), '(?i)(api[-_ ]?key[\t\n\x0B\f\r ]*[:=][\t\n\x0B\f\r ]*){_WS}+', '\1[redacted]', 'g'),
    '\b(?:sk|ak)-[A-Za-z0-9_-]{{8,}}\b', '[redacted-token]', 'g')"""


@query("c14_error_redaction", f"""SELECT doc_id, md5(m) AS masked_md5, CASE WHEN category <> 'UNKNOWN' OR tx = '' THEN category WHEN length(m) > 200
      THEN left(m, 200) || '...' ELSE m END AS audit_message
    FROM (SELECT doc_id, {_category('text')} AS category, {_MASKED} AS m, tx FROM (SELECT doc_id, text, {_TRIM.format(c='text')} AS tx FROM documents))""")
def _redact(t):
    return spread(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", F.md5(X.mask_secrets(X.jtrim("text"))).alias("masked_md5"), X.audit_message("text").alias("audit_message"))


@query("c15_failure_taxonomy", """WITH f AS (SELECT id, k, CASE CAST(k % 7 AS INT) WHEN 0 THEN 'RATE_LIMITED' WHEN 1 THEN 'TIMEOUT' WHEN 2 THEN 'PERMISSION_DENIED'
      WHEN 3 THEN 'NOT_FOUND' WHEN 4 THEN 'INVALID_ARGUMENT' ELSE 'INTERNAL' END AS error_type FROM tool_calls)
    SELECT id, error_type, error_type IN ('RATE_LIMITED', 'TIMEOUT') AS retryable, CASE error_type WHEN 'RATE_LIMITED' THEN 'RETRY_WITH_BACKOFF'
      WHEN 'TIMEOUT' THEN 'RETRY_WITH_SMALLER_SCOPE' WHEN 'PERMISSION_DENIED' THEN 'REQUEST_PERMISSION' WHEN 'NOT_FOUND' THEN 'CLARIFY_RESOURCE'
      WHEN 'INVALID_ARGUMENT' THEN 'REWRITE_ARGUMENTS' ELSE 'STOP_OR_FALLBACK' END AS suggested_action,
      (400 + k * 2) IN (401, 403, 408, 429) OR 400 + k * 2 >= 500 AS failover FROM f""")
def _taxonomy(t):
    names = [n for n, _, _ in R.FAILURES[:5]]
    kind = F.get(F.array(*[F.lit(n) for n in names], F.lit("ODD"), F.lit("OTHER")), F.col("k") % 7)
    calls = t.tool_calls.select("id", "k", kind.alias("failure"))
    return R.classify_failures(calls).select("id", "error_type", "retryable", "suggested_action", R.can_failover(400 + F.col("k") * 2).alias("failover"))


@query("c16_lenient_timestamps", """SELECT event_id, CAST(epoch(CASE k WHEN 0 THEN date_trunc('day', ts) WHEN 1 THEN date_trunc('hour', ts) WHEN 2 THEN date_trunc('minute', ts)
      WHEN 3 THEN date_trunc('second', ts) END) AS BIGINT) AS range_start,
      CAST(epoch(CASE k WHEN 0 THEN date_trunc('day', ts) + INTERVAL 1 DAY - INTERVAL 1 SECOND WHEN 1 THEN date_trunc('hour', ts) + INTERVAL 1 HOUR - INTERVAL 1 SECOND
      WHEN 2 THEN date_trunc('minute', ts) + INTERVAL 59 SECOND WHEN 3 THEN date_trunc('second', ts) END) AS BIGINT) AS range_end
    FROM (SELECT *, CAST(event_id % 4 AS INT) AS k FROM events)""")
def _lenient(t):
    full = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.left(full, F.get(F.array(F.lit(10), F.lit(13), F.lit(16), F.lit(19)), (F.col("event_id") % 4).cast("int")))
    return t.events.select("event_id", F.unix_seconds(R.lenient_timestamp(text)).alias("range_start"),
                           F.unix_seconds(R.lenient_timestamp(text, end_of_range=True)).alias("range_end"))


@query("c17_citation_ids", r"""WITH a AS (SELECT conv_id, pos, '[' || (pos + 1) || '] ' || content || ' [' || (conv_id % 7) || '] [' || (pos + 1) || ']' AS answer FROM messages),
    f AS (SELECT conv_id, pos, regexp_extract_all(answer, '\[(\d+)\]', 1) AS ids FROM a)
    SELECT conv_id, pos, array_to_string(list_filter(ids, lambda e, i: list_position(ids, e) = i), ',') AS citations FROM f""")
def _citations(t):
    answer = F.format_string("[%d] %s [%d] [%d]", F.col("pos") + 1, F.col("content"), F.col("conv_id") % 7, F.col("pos") + 1)
    return t.messages.select("conv_id", "pos", F.array_join(X.citation_ids(answer), ",").alias("citations"))


@query("c18_json_path", """SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, coalesce(json_extract_string(props, '$.missing'), '-') AS missing FROM events""")
def _json(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"),
                           F.coalesce(F.get_json_object("props", "$.missing"), F.lit("-")).alias("missing"))


@query("c19_evidence_snippet", rf"""WITH s AS (SELECT conv_id, pos, {_SQUEEZE.format(c="CASE WHEN pos % 4 = 0 THEN left(content, 50) ELSE '' END")} AS heading,
      CASE WHEN length({_SQUEEZE.format(c='content')}) > 800 THEN left({_SQUEEZE.format(c='content')}, 800) || '…' ELSE {_SQUEEZE.format(c='content')} END AS passage FROM messages),
    b AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(passage, '([。！？!?；;])', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 12) AS ss FROM s),
    c AS (SELECT conv_id, pos, CASE WHEN heading <> '' THEN heading WHEN passage = '' THEN 'question' ELSE coalesce(ss[1], passage) END AS best FROM b)
    SELECT conv_id, pos, CASE WHEN length(best) > 160 THEN left(best, 160) || '…' ELSE best END AS snippet FROM c""")
def _snippet(t):
    heading = F.when(F.col("pos") % 4 == 0, F.left("content", F.lit(50)))
    return t.messages.select("conv_id", "pos", X.evidence_snippet(heading, "content", F.lit("question")).alias("snippet"))


@query("c20_prices", r"""SELECT o_orderkey AS order_id, CAST(round(o_totalprice * 100, 0) AS BIGINT) AS cents,
      regexp_replace(regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '\.00$', ''), '(\.\d)0$', '\1') AS yuan, o_totalprice > 0 AS legal FROM orders""")
def _prices(t):
    text = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return t.orders.select(F.col("o_orderkey").alias("order_id"), R.cents(text).alias("cents"), R.yuan(R.cents(text)).alias("yuan"), R.legal_price(text).alias("legal"))


@query("c20_discounts", """SELECT l_orderkey AS order_id, l_linenumber AS line_no, CAST(round(l_discount * 100) AS INT) AS percent,
      CAST(CAST(round(l_discount * 100) / 10 AS DECIMAL(18,1)) AS VARCHAR) AS discount FROM lineitem""")
def _discounts(t):
    text = (F.col("l_discount") * 10).cast("decimal(18,1)").cast("string")
    return t.lineitem.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), R.discount_percent(text).alias("percent"),
                             R.percent_discount(R.discount_percent(text)).alias("discount"))
