"""Domain tables (files, users, runs, ledgers, ...) derived from the given tables.

Each entry of ``SQL`` is one SELECT that both Spark and DuckDB read. ``{name}`` refers to a given table or to
another entry. Where the two dialects differ, the entry is a pair (Spark text, DuckDB text). The library itself
never looks in here: operators take DataFrames with the documented columns.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from corpuscope.operators.holding import held_pairs
from corpuscope.session import ship_package
from corpuscope.sources.tables import GIVEN_TABLES, read_table

_EXTENSION = """CASE CAST(n_chars % 9 AS INT) WHEN 0 THEN '.pdf' WHEN 1 THEN '.TXT' WHEN 2 THEN '.md' WHEN 3 THEN '.png'
    WHEN 4 THEN '.zip' WHEN 5 THEN '.xyz' WHEN 6 THEN '' WHEN 7 THEN '.docx' ELSE '.' END"""
_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
_RUN = "concat('g', CAST(user_id AS STRING), '-', CAST(CAST(floor(event_id / 500) AS BIGINT) AS STRING))"

SQL: dict[str, str | tuple[str, str]] = {
    # one row per uploaded file; copies of one text by one owner occur
    "files": f"""SELECT doc_id, md5(text) AS file_md5,
        concat('file_', source, '_', CAST(n_chars % 3 AS STRING), {_EXTENSION}) AS file_name,
        n_chars * 2048 AS total_size, n_chars,
        CAST(CASE WHEN doc_id % 10 = 0 THEN 0 WHEN doc_id % 13 = 0 THEN 2 ELSE 1 END AS INT) AS status,
        n_chars % 40 AS user_id,
        CASE WHEN doc_id % 11 = 0 THEN 'DEFAULT' WHEN doc_id % 7 = 0 THEN concat('R', CAST(doc_id % 5 AS STRING))
             WHEN doc_id % 17 = 0 THEN concat('PRIVATE_', CAST(n_chars % 40 AS STRING)) WHEN doc_id % 19 = 0 THEN NULL
             ELSE concat('N', substr(source, 4)) END AS org_tag,
        doc_id % 6 = 0 AS is_public,
        TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * doc_id AS created_at,
        CASE WHEN doc_id % 3 = 0 THEN NULL
             ELSE TIMESTAMP '2024-01-02 00:00:00' + INTERVAL '1' MINUTE * (doc_id % 50) END AS merged_at,
        CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(n_chars % 12 AS INT) END AS est_chunks,
        CASE WHEN doc_id % 5 = 0 THEN 'COMPLETED' ELSE NULL END AS vectorization_status,
        CASE WHEN doc_id % 8 = 1 THEN n_chars ELSE NULL END AS actual_tokens
        FROM {{documents}}""",
    # retrieval view of a document with its access columns
    "docs": """SELECT doc_id, text, lang, source, n_chars % 40 AS owner_id,
        CASE WHEN doc_id % 11 = 0 THEN 'DEFAULT' WHEN doc_id % 7 = 0 THEN concat('R', CAST(doc_id % 5 AS STRING))
             ELSE concat('N', substr(source, 4)) END AS org_tag,
        doc_id % 6 = 0 AS is_public FROM {documents}""",
    "lines": (
        """SELECT doc_id, pos, line FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) AS pos, line""",
        """SELECT doc_id, CAST(unnest(range(0, len(parts))) AS INT) AS pos, unnest(parts) AS line
           FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM {documents})""",
    ),
    # child passages: one per non-empty line, five lines to a page
    "passages": """SELECT doc_id, pos, CAST(floor(pos / 5) AS INT) + 1 AS page, line AS text FROM {lines}
        WHERE length(trim(line)) > 0""",
    "vectors": """SELECT vec_id AS doc_id, embedding, label, vec_id % 40 AS owner_id,
        CASE WHEN vec_id % 11 = 0 THEN 'DEFAULT' ELSE concat('N', CAST(vec_id % 20 AS STRING)) END AS org_tag,
        vec_id % 6 = 0 AS is_public FROM {embeddings}""",
    "questions": """SELECT item_id AS query_id, text, item_id % 40 AS user_id FROM {benchmark}""",
    "question_vectors": """SELECT b.item_id AS query_id, b.item_id % 40 AS user_id, e.embedding, e.label
        FROM {benchmark} b JOIN {embeddings} e ON b.item_id = e.vec_id""",
    "users": """SELECT c_custkey AS user_id, c_name AS username,
        CASE WHEN c_custkey % 25 = 3 THEN 'ADMIN' ELSE 'USER' END AS role,
        CASE WHEN c_custkey % 9 = 4 THEN '' WHEN c_custkey % 3 = 0
             THEN concat('N', CAST(c_nationkey AS STRING), ',N', CAST((c_nationkey + 7) % 25 AS STRING))
             ELSE concat('N', CAST(c_nationkey AS STRING)) END AS org_tags,
        concat('N', CAST(c_nationkey AS STRING)) AS primary_org,
        TIMESTAMP '2023-01-01 00:00:00' + INTERVAL '1' HOUR * (c_custkey % 500) AS created_at, c_acctbal
        FROM {customer}""",
    "org_tags": """SELECT 'DEFAULT' AS tag_id, 'Default' AS name, CAST(NULL AS STRING) AS parent_tag,
            CAST(1000000 AS BIGINT) AS upload_max_size_bytes
        UNION ALL SELECT concat('R', CAST(r_regionkey AS STRING)), r_name, CAST(NULL AS STRING), CAST(9000000 AS BIGINT)
        FROM {region}
        UNION ALL SELECT concat('N', CAST(n_nationkey AS STRING)), n_name, concat('R', CAST(n_regionkey AS STRING)),
            CAST(2000000 + n_nationkey * 100000 AS BIGINT) FROM {nation}""",
    "messages": """SELECT conv_id, turn AS pos, role, text AS content, conv_id % 20 AS user_id FROM {conversations}""",
    "ledger": """SELECT event_id, user_id, ts, CAST(ts AS DATE) AS record_date,
        CASE WHEN event_type IN ('click', 'signup') THEN 'EMBEDDING' ELSE 'LLM' END AS token_type,
        CASE WHEN event_type = 'purchase' OR (event_type = 'signup' AND event_id % 2 = 0) THEN 'INCREASE' ELSE 'CONSUME' END
            AS change_type,
        CAST(round(value * 100, 0) AS BIGINT) AS amount FROM {events}""",
    # a run is one user's events inside a block of 500 event ids, so it has at most 500 steps
    "steps": f"""SELECT event_id AS id, {_RUN} AS generation_id, user_id,
        concat('s', CAST({_K} % 6 AS STRING)) AS step_id, event_type AS stage,
        CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'completed' END AS status,
        {_K} AS k, value, ts AS occurred_at FROM {{events}}""",
    "runs": """SELECT generation_id, user_id, CASE WHEN attempt > 1 AND user_id % 3 <> 0 THEN
            concat('g', CAST(user_id AS STRING), '-', CAST(block - 1 AS STRING)) END AS retry_of,
        attempt, status, prompt_tokens, completion_tokens, created_at, finished_at, conversation_id FROM (
          SELECT generation_id, user_id, block, CASE WHEN block % 4 = 0 THEN 1 ELSE block % 4 + 1 END AS attempt,
            CASE max_by(stage, id) WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'COMPLETED'
              WHEN 'purchase' THEN 'COMPLETED' ELSE CASE WHEN user_id % 2 = 0 THEN 'CANCELLED' ELSE 'INTERRUPTED' END END AS status,
            CAST(sum(k) AS BIGINT) AS prompt_tokens, CAST(count(*) * 7 AS BIGINT) AS completion_tokens,
            min(occurred_at) AS created_at, max(occurred_at) AS finished_at,
            concat('c', CAST(user_id % 30 AS STRING)) AS conversation_id
          FROM (SELECT *, CAST(floor(id / 500) AS BIGINT) AS block FROM {steps}) GROUP BY generation_id, user_id, block) r""",
    "tool_calls": f"""SELECT event_id AS id, {_RUN} AS generation_id, user_id, event_type AS tool,
        concat(event_type, ':', CAST({_K} % 4 AS STRING)) AS fingerprint,
        CASE WHEN event_type = 'purchase' THEN 'WRITE' ELSE 'READ' END AS effect,
        CASE WHEN event_type = 'purchase' THEN 'AT_MOST_ONCE' WHEN event_type = 'signup' THEN 'REQUIRES_APPROVAL'
             ELSE 'SAFE' END AS replay_policy,
        CASE CAST({_K} % 5 AS INT) WHEN 0 THEN 'FAILED' WHEN 1 THEN 'REUSED' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN 'REJECTED'
             ELSE 'SUCCESS' END AS status,
        ts AS started_at, value, {_K} AS k FROM {{events}} WHERE event_type <> 'view'""",
    "feedback": """SELECT conv_id * 1000 + turn AS feedback_id, conv_id % 20 AS user_id,
        CASE WHEN turn % 4 = 1 THEN 'bad' ELSE 'good' END AS rating,
        CASE WHEN turn % 3 = 0 THEN NULL ELSE substr(text, 1, 40) END AS reason,
        text AS source_query,
        CASE WHEN turn % 8 = 1 THEN substr(text, 1, 30) ELSE NULL END AS correction,
        TIMESTAMP '2024-02-01 00:00:00' + INTERVAL '1' MINUTE * (conv_id * 10 + turn) AS ts FROM {conversations}""",
    "memories": """SELECT conv_id * 1000 + turn AS memory_id, conv_id % 20 AS owner_id,
        CASE WHEN turn % 2 = 1 THEN 'CORRECTION' ELSE 'PREFERENCE' END AS memory_type,
        CASE WHEN turn % 5 = 4 THEN 'PROPOSED' ELSE 'ACTIVE' END AS status,
        substr(text, 1, 200) AS content, substr(text, 1, 60) AS source_query,
        CASE WHEN turn % 2 = 1 THEN CAST(0.95 AS DOUBLE) ELSE CAST(0.78 AS DOUBLE) END AS confidence,
        CASE WHEN turn % 3 = 0 THEN NULL
             ELSE TIMESTAMP '2024-03-01 00:00:00' + INTERVAL '1' HOUR * (conv_id % 100) END AS expires_at,
        TIMESTAMP '2024-02-01 00:00:00' + INTERVAL '1' MINUTE * (conv_id * 10 + turn) AS updated_at FROM {conversations}""",
    # documents that hold a benchmark text, whatever its length and words; ``Tables`` finds the same pairs by a scan of the bytes, see ``held_pairs``
    "qrels": (
        """SELECT DISTINCT b.item_id AS query_id, d.doc_id FROM {benchmark} b JOIN {documents} d ON contains(d.text, b.text)""",
        """SELECT b.item_id AS query_id, d.doc_id FROM {benchmark} b JOIN {documents} d ON contains(d.text, b.text)""",
    ),
    "recharge_orders": """SELECT o_orderkey AS order_id, o_custkey AS user_id,
        concat('T', CAST(o_orderkey - o_orderkey % 3 AS STRING)) AS trade_no,
        CASE o_orderstatus WHEN 'F' THEN 'SUCCEED' WHEN 'O' THEN 'NOT_PAY' ELSE 'FAILED' END AS status,
        CAST(round(o_totalprice * 100, 0) AS BIGINT) AS amount_cents, o_orderdate AS created_at,
        1 + o_orderkey % 5 AS package_units FROM {orders}""",
    # expected against actual behaviour of one run: the label sides and the stored facts
    "attempt_labels": f"""SELECT event_id, {_RUN} AS case_id,
        CASE CAST({_K} % 3 AS INT) WHEN 0 THEN ' Compare' WHEN 1 THEN 'SUMMARY' ELSE event_type END AS expected_label,
        CASE CAST({_K} % 4 AS INT) WHEN 0 THEN 'compare ' WHEN 1 THEN 'summary' WHEN 2 THEN '' ELSE event_type END AS actual_label,
        value > 50 AS expected_flag, {_K} > 50 AS actual_flag, value, {_K} AS k FROM {{events}}""",
}

_REF = re.compile(r"\{(\w{2,})\}")


def _text(name: str, dialect: int) -> str:
    entry = SQL[name]
    return entry if isinstance(entry, str) else entry[dialect]


@lru_cache(maxsize=None)
def _needs(name: str) -> tuple[str, ...]:
    """Bindings that ``name`` is built from, innermost first, itself last."""
    found: list[str] = []
    for ref in _REF.findall(_text(name, 1)):
        if ref in SQL:
            found += [n for n in _needs(ref) if n not in found]
    return (*found, name)


def with_bindings(sql: str) -> str:
    """DuckDB text: the query behind one common table expression per binding that it names."""
    used: list[str] = []
    for name in SQL:
        if re.search(rf"\b{name}\b", sql):
            used += [n for n in _needs(name) if n not in used]
    if not used:
        return sql
    heads = ", ".join(f"{n} AS ({_REF.sub(r'\1', _text(n, 1))})" for n in used)
    body = sql.strip()
    recursive = re.match(r"(?is)with\s+recursive\s+", body)
    plain = re.match(r"(?is)with\s+", body)
    if recursive:
        return f"WITH RECURSIVE {heads}, {body[recursive.end():]}"
    if plain:
        return f"WITH {heads}, {body[plain.end():]}"
    return f"WITH {heads} {body}"


class Tables:
    """Attribute access to the given tables and the bindings of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        ship_package(spark)
        self.spark = spark
        self.folder = folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in SQL and name not in GIVEN_TABLES):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._read(name)
        return self._made[name]

    def once(self, name: str, make) -> DataFrame:
        """The DataFrame ``make()`` built at the first call under this name."""
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def _read(self, name: str) -> DataFrame:
        if name in GIVEN_TABLES:
            return read_table(self.spark, self.folder, name)
        if name == "qrels":
            return held_pairs(self.documents, self.benchmark).withColumnRenamed("item_id", "query_id").distinct()
        text = _text(name, 0)
        inputs = {ref: getattr(self, ref) for ref in set(_REF.findall(text))}
        return self.spark.sql(text, **inputs)
