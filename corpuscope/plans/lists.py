"""Permission, listing and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.operators import access, fuse, listing
from corpuscope.plans import fragments as sql
from corpuscope.plans.planning import _MASKED, _TRIM, _category
from corpuscope.plans.registry import query
from corpuscope.plans.retrieval import lists_of, FUSED

_RECURSIVE = f"WITH RECURSIVE {sql.EFFECTIVE}"


@query("d01_accessible_documents", f"""{_RECURSIVE} SELECT u.user_id, count(DISTINCT d.doc_id) AS documents, CAST(sum(DISTINCT d.doc_id) AS BIGINT) AS id_sum
    FROM users u JOIN docs d ON d.owner_id = u.user_id OR d.is_public OR (u.user_id, d.org_tag) IN (SELECT (user_id, tag) FROM eff) GROUP BY 1""")
def _acl(t):
    found = access.accessible_files(t.users, t.org_tags, t.docs)
    own = access.accessible_totals(t.users, t.org_tags, found).select("user_id", F.col("n").alias("_n"), F.col("id_sum").alias("_s"))
    everyone = found.where("user_id IS NULL AND tag IS NULL")
    n_public, s_public = everyone.select(F.count("*")).scalar(), everyone.select(F.sum("doc_id")).scalar()
    return t.users.select("user_id").join(own, "user_id", "left").select(
        "user_id", (F.coalesce("_n", F.lit(0)) + n_public).alias("documents"), (F.coalesce("_s", F.lit(0)) + s_public).alias("id_sum"))


_PAIRS = "users u JOIN docs d ON d.owner_id = u.user_id OR d.is_public OR (u.user_id, d.org_tag) IN (SELECT (user_id, tag) FROM eff)"


@query("d01_access_bitmaps", f"{_RECURSIVE} SELECT u.user_id, count(DISTINCT d.doc_id) AS documents FROM {_PAIRS} GROUP BY 1")
def _bitmaps(t):
    return access.visible_counts(t.users, t.org_tags, access.access_bitmaps(t.users, t.org_tags, t.docs))


@query("d01_bitmap_membership", f"""{_RECURSIVE}, seen AS (SELECT u.user_id, d.doc_id FROM {_PAIRS}), asked AS (SELECT doc_id, (doc_id * 7 + 3) % 40 AS user_id FROM documents)
    SELECT a.user_id, a.doc_id, s.doc_id IS NOT NULL AS visible FROM asked a LEFT JOIN (SELECT DISTINCT * FROM seen) s ON s.user_id = a.user_id AND s.doc_id = a.doc_id""")
def _membership(t):
    # one question per document; users without an account see what is public
    asked = t.documents.select("doc_id", ((F.col("doc_id") * 7 + 3) % 40).alias("user_id"))
    return access.sees(asked, t.users, t.org_tags, access.access_bitmaps(t.users, t.org_tags, t.docs))


@query("d02_effective_tags", f"{_RECURSIVE} SELECT user_id, tag FROM eff")
def _tags(t):
    return access.effective_tags(t.users, t.org_tags)


@query("d03_tag_tree", f"""WITH RECURSIVE {sql.UP} SELECT tag_id, max(depth) AS level, string_agg(ancestor, '/' ORDER BY depth DESC) AS path,
    arg_max(ancestor, depth) AS root, (SELECT count(*) FROM org_tags c WHERE c.parent_tag = up.tag_id) AS children FROM up GROUP BY tag_id""")
def _tree(t):
    return access.tag_tree(t.org_tags)


@query("d04_cycle_test", f"""WITH RECURSIVE {sql.UP} SELECT r.tag_id, n.tag_id AS new_parent,
    EXISTS (SELECT 1 FROM up WHERE up.tag_id = n.tag_id AND up.ancestor = r.tag_id) AS cycle
    FROM (SELECT DISTINCT concat('R', CAST(c_custkey % 5 AS STRING)) AS tag_id, concat('N', CAST(c_nationkey AS STRING)) AS np FROM customer) r
    JOIN org_tags n ON n.tag_id = r.np""")
def _cycle(t):
    proposals = t.customer.select(F.concat(F.lit("R"), (F.col("c_custkey") % 5).cast("string")).alias("tag_id"),
                                  F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("new_parent")).distinct()
    return access.forms_cycle(proposals, t.org_tags)


@query("d05_tag_deletability", """SELECT t.tag_id, CASE WHEN t.tag_id = 'DEFAULT' THEN 'DEFAULT_TAG' WHEN EXISTS (SELECT 1 FROM org_tags c WHERE c.parent_tag = t.tag_id) THEN 'HAS_CHILDREN'
      WHEN EXISTS (SELECT 1 FROM users u WHERE list_contains(string_split(u.org_tags, ','), t.tag_id)) THEN 'USED_BY_USERS'
      WHEN EXISTS (SELECT 1 FROM users u WHERE u.primary_org = t.tag_id) THEN 'PRIMARY_TAG'
      WHEN EXISTS (SELECT 1 FROM docs d WHERE d.org_tag = t.tag_id) THEN 'USED_BY_FILES' ELSE 'DELETABLE' END AS reason FROM org_tags t""")
def _deletable(t):
    return access.tag_deletability(t.org_tags, t.users, t.docs)


@query("d06_user_list", """SELECT user_id, username, role, (SELECT count(*) FROM users WHERE contains(lower(username), '1') AND list_contains(string_split(org_tags, ','), 'N5') AND role = 'USER') AS total
    FROM users WHERE contains(lower(username), '1') AND list_contains(string_split(org_tags, ','), 'N5') AND role = 'USER' ORDER BY created_at DESC, user_id DESC LIMIT 10 OFFSET 10""")
def _users(t):
    matching = access.list_users(t.users, keyword="1", tag="N5", role="USER")
    return listing.page(matching, [F.desc("created_at"), F.desc("user_id")], 2, 10).select("user_id", "username", "role", "total")


@query("d07_paged_listing", """SELECT event_id, user_id, amount, (SELECT count(*) FROM ledger) AS total, CAST(ceil((SELECT count(*) FROM ledger) / 25.0) AS BIGINT) AS pages
    FROM ledger ORDER BY record_date DESC, event_id DESC LIMIT 25 OFFSET 50""")
def _paged(t):
    return listing.page(t.ledger, [F.desc("record_date"), F.desc("event_id")], 3, 25).select("event_id", "user_id", "amount", "total", "pages")


@query("d08_time_range_history", """SELECT event_id, user_id, ts, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'""")
def _history(t):
    found = listing.history(t.events, "2024-01-05 00:00:00", "2024-01-12 12:00:00")
    return found.select("event_id", "user_id", "ts", "event_type").orderBy("ts", "event_id")


@query("d09_oversize_uploads", """SELECT * FROM (SELECT f.doc_id, f.user_id, f.org_tag, f.total_size, CASE WHEN f.doc_id % 4 = 0 THEN 0 ELSE f.n_chars % 2 * 5242880 + f.n_chars * 1024 END AS estimated_size, o.upload_max_size_bytes
      FROM files f JOIN org_tags o ON o.tag_id = f.org_tag JOIN users u ON u.user_id = f.user_id WHERE u.role <> 'ADMIN' AND o.upload_max_size_bytes > 0)
    WHERE total_size > upload_max_size_bytes OR estimated_size > upload_max_size_bytes""")
def _oversize(t):
    # the last part seen of three uploads in four
    parts = t.files.where("doc_id % 4 <> 0").select("doc_id", (F.col("n_chars") % 2).alias("part_index"), (F.col("n_chars") * 1024).alias("part_size"))
    return access.oversize_uploads(t.files, t.users, t.org_tags, parts)


_ACCOUNT = "CASE WHEN user_id % 10 = 0 THEN concat('system-', CAST(user_id AS STRING)) WHEN user_id % 10 = 1 THEN ' ' ELSE CAST(user_id AS STRING) END"


@query("d10_quota_managed", f"""SELECT account, count(*) AS events FROM (SELECT {_ACCOUNT} AS account FROM events) a WHERE trim(account) <> '' AND NOT starts_with(account, 'system') GROUP BY 1""")
def _managed(t):
    accounts = t.events.select(F.expr(_ACCOUNT).alias("account"))
    return accounts.where(access.quota_managed("account")).groupBy("account").agg(F.count("*").alias("events"))


_NOW = "TIMESTAMP '2024-03-03 00:00:00'"
ACTIVE = f"""active AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY updated_at DESC, memory_id DESC) AS rn FROM memories
    WHERE status = 'ACTIVE' AND (expires_at IS NULL OR expires_at > {_NOW})) WHERE rn <= 50)"""


@query("d11_active_memories", f"WITH {ACTIVE} SELECT memory_id, owner_id, memory_type FROM active")
def _memories(t):
    return listing.active_memories(t.memories, F.expr(_NOW)).select("memory_id", "owner_id", "memory_type")


LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY generation_id, step_id ORDER BY id DESC) AS rn FROM steps) WHERE rn = 1)"


_DETAIL = "concat('call https://api', CAST(k AS STRING), '.example.com failed with Bearer tok', CAST(k AS STRING), ' in ', stage)"


@query("d12_recoverable_runs", f"""WITH {LATEST}, early AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, conversation_id ORDER BY created_at, generation_id) AS n FROM runs) WHERE n <= 50),
    v AS (SELECT r.generation_id, r.status AS run_state, s.step_id, s.stage, CASE WHEN s.status = 'running' THEN CASE WHEN r.status = 'CANCELLED' THEN 'cancelled' ELSE 'failed' END ELSE s.status END AS step_state,
      CASE WHEN s.status = 'running' THEN '{listing.CLOSED_DETAIL}' ELSE {_DETAIL} END AS raw
      FROM early r LEFT JOIN latest s ON s.generation_id = r.generation_id WHERE r.status IN ('FAILED', 'INTERRUPTED', 'CANCELLED', 'WAITING_APPROVAL')),
    m AS (SELECT *, {_category('raw')} AS category, {_MASKED} AS masked FROM (SELECT *, {_TRIM.format(c='raw')} AS tx FROM v))
    SELECT generation_id, run_state, step_id, stage, step_state, CASE WHEN step_state <> 'failed' THEN raw WHEN category <> 'UNKNOWN' OR tx = '' THEN category WHEN length(masked) > 200 THEN left(masked, 200) || '...' ELSE masked END AS detail FROM m""")
def _recoverable(t):
    steps = t.steps.withColumn("detail", F.expr(_DETAIL))
    return listing.recoverable_runs(t.runs, steps).select("generation_id", "run_state", "step_id", "stage", "step_state", "detail")


@query("d13_orders_by_status", """SELECT order_id, user_id, amount_cents FROM recharge_orders WHERE status = 'SUCCEED' AND amount_cents > 1 ORDER BY created_at DESC, order_id DESC""")
def _orders(t):
    paid = t.recharge_orders.where("status = 'SUCCEED' AND amount_cents > 1")
    return paid.orderBy(F.desc("created_at"), F.desc("order_id")).select("order_id", "user_id", "amount_cents")


@query("d14_rate_settings", """WITH d AS (SELECT concat('chat:', event_type) AS config_key, count(*) AS max_requests, 60 AS window_seconds, event_type FROM events GROUP BY event_type),
    s AS (SELECT concat('chat:', event_type) AS config_key, CASE WHEN event_type = 'view' THEN NULL ELSE max(user_id) END AS mr, CASE WHEN event_type = 'click' THEN NULL ELSE 30 END AS ws
      FROM events WHERE event_type <> 'error' GROUP BY event_type)
    SELECT d.config_key, coalesce(s.mr, d.max_requests) AS max_requests, coalesce(s.ws, d.window_seconds) AS window_seconds FROM d LEFT JOIN s ON s.config_key = d.config_key""")
def _settings(t):
    key = F.concat(F.lit("chat:"), F.col("event_type")).alias("config_key")
    defaults = t.events.groupBy(key).agg(F.count("*").alias("max_requests"), F.lit(60).alias("window_seconds"))
    stored = t.events.where("event_type <> 'error'").groupBy(key).agg(
        F.max(F.when(F.col("event_type") != "view", F.col("user_id"))).alias("max_requests"),
        F.max(F.when(F.col("event_type") != "click", F.lit(30))).alias("window_seconds"))
    return listing.rate_settings(defaults, stored)


@query("d15_session_list", f"""SELECT conv_id, user_id, coalesce(left(arg_min(content, pos) FILTER (role = 'user'), 50), '{listing.DEFAULT_TITLE}') AS title, max(pos) AS last_pos FROM messages GROUP BY conv_id, user_id""")
def _sessions(t):
    return listing.sessions(t.messages).orderBy(F.desc("conv_id"))


_REASON = """CASE WHEN f.doc_id IS NULL THEN 'NOT_FOUND' WHEN f.is_public THEN 'PUBLIC' WHEN f.org_tag IS NULL OR f.org_tag IN ('', 'DEFAULT') THEN 'OPEN_TAG'
    WHEN u.user_id IS NULL THEN 'NO_IDENTITY' WHEN f.user_id = r.user_id THEN 'OWNER' WHEN u.role = 'ADMIN' THEN 'ADMIN' WHEN starts_with(f.org_tag, 'PRIVATE_') THEN 'PRIVATE_TAG'
    WHEN u.org_tags = '' THEN 'NO_TAGS' WHEN list_contains(string_split(u.org_tags, ','), f.org_tag) THEN 'TAG_MATCH' ELSE 'TAG_MISMATCH' END"""


@query("d16_access_decisions", f"""WITH r AS (SELECT event_id, user_id * 11 AS user_id, event_id % (SELECT count(*) + 300 FROM files) AS doc_id FROM events)
    SELECT r.event_id, {_REASON} AS reason, {_REASON} IN ('PUBLIC', 'OPEN_TAG', 'OWNER', 'ADMIN', 'TAG_MATCH') AS allowed FROM r LEFT JOIN files f ON f.doc_id = r.doc_id LEFT JOIN users u ON u.user_id = r.user_id""")
def _decisions(t):
    asked = t.files.count() + 300  # every document, and some that are not there
    requests = t.events.select("event_id", (F.col("user_id") * 11).alias("user_id"), (F.col("event_id") % asked).alias("doc_id"))
    resources = t.files.withColumnRenamed("user_id", "owner_id")
    keyed = requests.select("user_id", "doc_id").distinct()
    return requests.join(access.access_decisions(keyed, resources, t.users), ["user_id", "doc_id"]).select("event_id", "reason", "allowed")


@query("e01_hit_file_names", f"""{FUSED} SELECT x.query_id, x.doc_id, x.rank, (SELECT min(f.file_name) FROM files f WHERE f.doc_id = x.doc_id) AS file_name FROM ({sql.topk('fused', 10, score='rrf_score')}) x""")
def _names(t):
    return fuse.attach_names(fuse.rrf(lists_of(t), 10), t.files).select("query_id", "doc_id", "rank", "file_name")


@query("e02_parent_lookup", """WITH num AS (SELECT doc_id, pos, CAST(floor(pos / 3) AS INT) AS g FROM passages), par AS (SELECT doc_id, g, count(*) AS children FROM num GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT num.doc_id, num.pos, coalesce(par.children, 0) AS siblings FROM num LEFT JOIN par ON par.doc_id = num.doc_id AND par.g = num.g""")
def _parent(t):
    child = t.passages.select("doc_id", "pos", F.floor(F.col("pos") / 3).cast("int").alias("g"))
    parent = child.groupBy("doc_id", "g").agg(F.count("*").alias("children")).where("children > 1")
    return child.join(parent, ["doc_id", "g"], "left").select("doc_id", "pos", F.coalesce("children", F.lit(0)).alias("siblings"))


@query("e03_ledger_names", """SELECT l.event_id, l.user_id, coalesce(u.username, 'Unknown User') AS username FROM ledger l LEFT JOIN users u ON u.user_id = l.user_id""")
def _ledger_names(t):
    return listing.names_for(t.ledger.select("event_id", "user_id"), t.users).select("event_id", "user_id", "username")


@query("e04_tag_details", """SELECT u.user_id, coalesce(string_agg(coalesce(o.name, x.tag_id), ',' ORDER BY x.i), '') AS tag_names FROM users u
    LEFT JOIN (SELECT user_id, unnest(range(0, len(string_split(org_tags, ',')))) AS i, unnest(string_split(org_tags, ',')) AS tag_id FROM users WHERE org_tags <> '') x ON x.user_id = u.user_id
    LEFT JOIN org_tags o ON o.tag_id = x.tag_id GROUP BY u.user_id""")
def _details(t):
    return listing.tag_details(t.users, t.org_tags)


@query("e04_file_tag_names", """SELECT f.doc_id, coalesce(o.name, f.org_tag) AS org_tag_name FROM files f LEFT JOIN org_tags o ON o.tag_id = f.org_tag""")
def _file_tags(t):
    return listing.file_tag_names(t.files, t.org_tags).select("doc_id", "org_tag_name")


@query("e05_latest_steps", f"""WITH {LATEST} SELECT r.generation_id, r.status AS run_status, l.step_id, l.id, l.stage, l.status FROM runs r JOIN latest l ON l.generation_id = r.generation_id""")
def _latest(t):
    runs = t.runs.select("generation_id", F.col("status").alias("run_status"))
    return runs.join(listing.latest_steps(t.steps), "generation_id").select("generation_id", "run_status", "step_id", "id", "stage", "status")


@query("e06_low_balance", """SELECT user_id, token_type, event_id, 5000 - amount AS balance_after FROM ledger l WHERE record_date = (SELECT max(record_date) FROM ledger m WHERE m.user_id = l.user_id AND m.token_type = l.token_type)
    AND 5000 - amount <= 1000""")
def _low(t):
    rows = t.ledger.withColumn("balance_after", 5000 - F.col("amount"))
    return listing.low_balance(rows, 1000).select("user_id", "token_type", "event_id", "balance_after")


@query("e08_unexecuted_variants", """WITH v AS (SELECT DISTINCT conv_id AS query_id, lower(role || ' ' || (pos % 3)) AS fp FROM messages), x AS (SELECT DISTINCT conv_id AS query_id, lower(role || ' ' || (pos % 2)) AS fp FROM messages)
    SELECT query_id, fp FROM v EXCEPT SELECT query_id, fp FROM x""")
def _unexecuted(t):
    def spelled(n):
        return t.messages.select(F.col("conv_id").alias("query_id"), F.lower(F.concat_ws(" ", "role", (F.col("pos") % n).cast("string"))).alias("fp"))

    return listing.unexecuted(spelled(3).distinct(), spelled(2))


@query("e09_retry_lineage", """WITH RECURSIVE chain AS (SELECT generation_id, generation_id AS root, 0 AS depth FROM runs WHERE retry_of IS NULL OR retry_of NOT IN (SELECT generation_id FROM runs)
      UNION ALL SELECT r.generation_id, c.root, c.depth + 1 FROM runs r JOIN chain c ON r.retry_of = c.generation_id)
    SELECT c.generation_id, c.root, c.depth, c.depth > 0 AND r.status = 'COMPLETED' AS recovered FROM chain c JOIN runs r ON r.generation_id = c.generation_id""")
def _lineage(t):
    return listing.retry_lineage(t.runs)


@query("e10_latest_checkpoints", """SELECT generation_id, max(id) AS latest_id, max(CASE WHEN starts_with(stage, 'c') THEN id ELSE -1 END) AS latest_click, max(CASE WHEN starts_with(stage, 'p') THEN id ELSE -1 END) AS latest_purchase FROM steps GROUP BY 1""")
def _checkpoints(t):
    rows = t.steps.withColumnRenamed("stage", "checkpoint_type")
    return listing.latest_checkpoints(rows, {"latest_click": "c", "latest_purchase": "p"}).fillna(-1)


@query("e11_evidence_references", f"""{FUSED}, k AS ({sql.topk('fused', 8, score='rrf_score')}), s AS (SELECT 'g' || (query_id % 7) AS generation_id, max(query_id) AS query_id FROM k GROUP BY 1)
    SELECT s.generation_id, k.doc_id, row_number() OVER (PARTITION BY s.generation_id ORDER BY k.rank, k.doc_id) AS ref_no FROM s JOIN k ON k.query_id = s.query_id""")
def _references(t):
    hits = fuse.rrf(lists_of(t), 8)
    searches = hits.select(F.concat(F.lit("g"), (F.col("query_id") % 7).cast("string")).alias("generation_id"), F.col("query_id").alias("search_id")).distinct()
    return listing.evidence_references(searches, hits.withColumnRenamed("query_id", "search_id")).select("generation_id", "doc_id", "ref_no")


@query("e12_credit_postings", """WITH paid AS (SELECT trade_no, min(order_id) AS order_id, arg_min(user_id, order_id) AS user_id, arg_min(package_units, order_id) AS pu FROM recharge_orders WHERE status = 'SUCCEED' GROUP BY 1),
    posted AS (SELECT DISTINCT trade_no FROM recharge_orders WHERE order_id % 9 = 0)
    SELECT trade_no, order_id, user_id, pu * 1000 AS amount, k.token_type FROM paid, (SELECT unnest(['LLM', 'EMBEDDING']) AS token_type) k WHERE trade_no NOT IN (SELECT trade_no FROM posted)""")
def _postings(t):
    return listing.credit_postings(t.recharge_orders, t.recharge_orders.where("order_id % 9 = 0"))
