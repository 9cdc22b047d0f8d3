"""Limits, reservations, ledgers, ingestion sources and sinks, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.functions.times import micros
from corpuscope.operators import ledgers, limits
from corpuscope.operators import evaluate as E
from corpuscope.plans.evaluation import SIGNALS, r4
from corpuscope.plans.lists import LATEST
from corpuscope.plans.registry import query
from corpuscope.session import cut_lineage
from corpuscope.sources import golden
from corpuscope.sources.files import write_files
from corpuscope.sources.segments import SegmentIndex
from corpuscope.streaming import keyed, pipeline, retries, state

EV = "ev AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS us, epoch_us(ts) // 1000 * 1000 AS t FROM events)"


def _window_sql(source: str, prefix: str, seconds: int, maximum: int) -> str:
    """Windows and the position of every event in its window."""
    width = seconds * 1_000_000
    return f"""{prefix}_s AS (SELECT key, min(t) AS s FROM {source} GROUP BY key
      UNION ALL SELECT w.key, min(e.t) FROM {prefix}_s w JOIN {source} e ON e.key = w.key AND e.t >= w.s + {width} GROUP BY w.key),
    {prefix} AS (SELECT e.key, e.id, e.us, e.t, w.s, row_number() OVER (PARTITION BY e.key, w.s ORDER BY e.us, e.id) AS n,
      row_number() OVER (PARTITION BY e.key, w.s ORDER BY e.us, e.id) <= {maximum} AS accepted FROM {source} e JOIN {prefix}_s w ON w.key = e.key AND e.t >= w.s AND e.t < w.s + {width})"""


def keyed_events(t):
    return t.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts")


def stream_of(t, name):
    """The given table as a file stream."""
    return pipeline.read_stream(t.spark, f"{t.folder}/{name}.parque[t]", getattr(t, name).schema)


_K1 = f"WITH RECURSIVE {EV}, {_window_sql('ev', 'w', 21600, 3)} SELECT key, id, accepted FROM w"


@query("k01_window_limit", f"""WITH RECURSIVE {EV}, {_window_sql('ev', 'w', 21600, 3)} SELECT key, id, accepted, CASE WHEN accepted THEN -1 ELSE CAST(floor((s + 21600000000 - t) / 1000000.0::DOUBLE + 0.5) AS BIGINT) END AS retry_after FROM w""")
def _limit(t):
    out = limits.fixed_window_limit(keyed_events(t), 3, 21600)
    return out.select("key", "id", "accepted", F.coalesce("retry_after", F.lit(-1)).alias("retry_after"))


@query("k01_window_limit_stream", _K1)
def _limit_stream(t):
    rows = stream_of(t, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts")
    return pipeline.drain(keyed.limit_stream(rows, 3, 21600), "limit")


_K2 = f"""WITH RECURSIVE {EV}, {_window_sql('ev', 'm', 21600, 2)}, pass AS (SELECT key, id, us, t FROM m WHERE accepted), {_window_sql('pass', 'd', 86400, 3)}
    SELECT key, id, CASE WHEN accepted THEN 'ACCEPTED' ELSE 'DAY_LIMIT' END AS verdict FROM d UNION ALL SELECT key, id, 'MINUTE_LIMIT' FROM m WHERE NOT accepted"""


@query("k02_dual_window_limit", _K2)
def _dual(t):
    return limits.dual_window_limit(keyed_events(t), 2, 21600, 3, 86400).select("key", "id", "verdict")


@query("k02_dual_window_limit_stream", _K2)
def _dual_stream(t):
    rows = stream_of(t, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts")
    return pipeline.drain(keyed.dual_limit_stream(rows, 2, 21600, 3, 86400), "dual")


_K4 = """WITH RECURSIVE q AS (SELECT user_id, event_id AS id, CAST(ts AS DATE) AS d, CAST(round(value * 100, 0) AS BIGINT) AS a, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS n FROM events),
    f AS (SELECT user_id, id, d, n, CASE WHEN a <= 9000 THEN a ELSE 0 END AS total, a <= 9000 AS admitted FROM q WHERE n = 1
      UNION ALL SELECT q.user_id, q.id, q.d, q.n, f.total + CASE WHEN f.total + q.a <= 9000 THEN q.a ELSE 0 END, f.total + q.a <= 9000 FROM f JOIN q ON q.user_id = f.user_id AND q.d = f.d AND q.n = f.n + 1)
    SELECT user_id, id, admitted FROM f"""


def requests(df):
    return df.select("user_id", F.col("event_id").alias("id"), "ts", F.round(F.col("value") * 100, 0).cast("long").alias("reserved"))


@query("k04_daily_reserve", _K4)
def _reserve(t):
    return limits.daily_reserve(requests(t.events), 9000).select("user_id", "id", "admitted")


@query("k04_daily_reserve_stream", _K4)
def _reserve_stream(t):
    return pipeline.drain(keyed.reserve_stream(requests(stream_of(t, "events")), 9000), "reserve").select("user_id", "id", "admitted")


@query("k05_global_budget_stream")
def _budget_stream(t):
    rows = requests(stream_of(t, "events")).withColumn("budget", F.lit("global"))
    return pipeline.drain(state.global_budget_stream(rows, user_limit=9000, minute_limit=12000, minute_seconds=3600, day_limit=150000, day_seconds=86400), "budget")


_K7 = """WITH RECURSIVE q AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS us, event_type IN ('error', 'click', 'view') AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT key, id, n, CASE WHEN failed THEN 1 ELSE 0 END AS fails, 0::BIGINT AS opened, 'CLOSED' AS state FROM q WHERE n = 1
      UNION ALL SELECT key, id, n, CASE WHEN open THEN fails WHEN failed THEN fails + 1 ELSE 0 END, CASE WHEN open THEN opened WHEN failed AND fails + 1 >= 3 THEN us ELSE 0 END,
        CASE WHEN open THEN 'OPEN' WHEN failed AND fails + 1 >= 3 THEN 'TRIPPED' ELSE 'CLOSED' END
      FROM (SELECT q.key, q.id, q.n, q.us, q.failed, f.opened, f.opened > 0 AND q.us <= f.opened + 43200000000 AS open, CASE WHEN f.opened > 0 AND q.us > f.opened + 43200000000 THEN 0 ELSE f.fails END AS fails
        FROM f JOIN q ON q.key = f.key AND q.n = f.n + 1) nx)
    SELECT key, id, state FROM f"""


def outcomes(df):
    return df.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", F.col("event_type").isin("error", "click", "view").alias("failed"))


@query("k07_failure_spans", _K7)
def _failures(t):
    return limits.failure_spans(outcomes(t.events), cooldown=43200).select("key", "id", "state")


@query("k07_failure_spans_stream", _K7)
def _failures_stream(t):
    return pipeline.drain(keyed.failure_stream(outcomes(stream_of(t, "events")), cooldown=43200), "failures")


@query("k03_clock_counters_stream", """SELECT user_id, epoch_us(date_trunc('day', ts)) AS window_us, count(*) AS requests, CAST(sum(round(value * 100, 0)) AS BIGINT) AS tokens FROM events GROUP BY ALL""")
def _counters_stream(t):
    from corpuscope.functions.times import micros
    from corpuscope.operators.usage import clock_counters

    rows = stream_of(t, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100, 0).cast("long").alias("amount"))
    counted = pipeline.drain_complete(clock_counters(rows), "counters")
    return counted.select("user_id", micros("window_start").alias("window_us"), "requests", "tokens")


_TERMINAL = "'COMPLETED', 'FAILED', 'CANCELLED', 'INTERRUPTED', 'RESUMED'"


@query("k08_run_transitions", f"""WITH s AS (SELECT id, generation_id, CASE stage WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'COMPLETED' ELSE 'RUNNING' END AS status, CASE WHEN k = 13 THEN 2 ELSE 1 END AS v FROM steps),
    e AS (SELECT generation_id, min(id) AS e FROM s WHERE v = 1 AND status IN ({_TERMINAL}) GROUP BY 1),
    m AS (SELECT s.id, s.generation_id, CASE WHEN v <> 1 THEN 'BAD_SCHEMA' WHEN s.id > e.e THEN 'AFTER_TERMINAL' ELSE 'OK' END AS verdict FROM s LEFT JOIN e ON e.generation_id = s.generation_id)
    SELECT id, verdict, CASE WHEN verdict = 'OK' THEN row_number() OVER (PARTITION BY generation_id, verdict ORDER BY id) ELSE 0 END AS state_version FROM m""")
def _transitions(t):
    status = F.when(F.col("stage") == "error", "FAILED").when(F.col("stage") == "purchase", "COMPLETED").otherwise("RUNNING")
    rows = t.steps.select("id", "generation_id", status.alias("status"), F.when(F.col("k") == 13, 2).otherwise(1).alias("schema_version"))
    return ledgers.transitions(rows).select("id", "verdict", "state_version")


@query("k09_run_ledger", f"WITH {LATEST} SELECT r.generation_id, r.status, arg_max(l.stage, l.id) AS stage, count(*) FILTER (l.status = 'running') AS open_steps FROM runs r JOIN latest l ON l.generation_id = r.generation_id GROUP BY 1, 2")
def _ledger(t):
    return ledgers.run_ledger(t.runs, t.steps)


@query("k09_closing_rows", f"""WITH {LATEST} SELECT l.generation_id, l.step_id, l.stage, CASE r.status WHEN 'COMPLETED' THEN 'completed' WHEN 'CANCELLED' THEN 'cancelled' ELSE 'failed' END AS status
    FROM latest l JOIN runs r ON r.generation_id = l.generation_id WHERE l.status = 'running' AND r.status IN ({_TERMINAL})""")
def _closing(t):
    return ledgers.closing_rows(t.runs, t.steps)


_NOW = "TIMESTAMP '2024-01-30 00:00:00'"


@query("k10_interrupted_runs", f"SELECT r.generation_id, 'INTERRUPTED' AS new_status FROM runs r JOIN (SELECT generation_id, max(occurred_at) AS last FROM steps GROUP BY 1) s ON s.generation_id = r.generation_id WHERE r.status = 'RUNNING' AND s.last < {_NOW} - INTERVAL 120 MINUTE")
def _interrupted(t):
    return ledgers.interrupted_runs(t.runs, t.steps, F.expr(_NOW), 120).select("generation_id", "new_status")


@query("k11_pending_tasks", """WITH task AS (SELECT user_id, max(event_id) AS task_id, max(ts) AS created_at FROM events WHERE event_type = 'signup' GROUP BY 1),
    ans AS (SELECT t.user_id, min(e.ts) AS answered_at FROM task t JOIN events e ON e.user_id = t.user_id AND e.event_type = 'click' AND e.ts >= t.created_at GROUP BY 1)
    SELECT t.user_id, t.task_id, CASE WHEN answered_at IS NULL THEN 'WAITING' WHEN t.created_at + INTERVAL 24 HOUR < answered_at THEN 'EXPIRED' ELSE 'RESUMED' END AS state FROM task t LEFT JOIN ans a ON a.user_id = t.user_id""")
def _pending(t):
    tasks = t.events.where("event_type = 'signup'").select("user_id", F.lit(1).alias("conversation_id"), F.col("event_id").alias("task_id"), F.col("ts").alias("created_at"),
                                                           F.expr("ts + INTERVAL '24' HOUR").alias("expires_at"))
    answers = t.events.where("event_type = 'click'").select("user_id", F.lit(1).alias("conversation_id"), "ts", F.col("props").alias("answer"))
    return ledgers.pending_tasks(tasks, answers).select("user_id", "task_id", "state")


@query("k12_tool_ledger", """WITH c AS (SELECT *, lag(status) OVER (PARTITION BY generation_id, fingerprint ORDER BY id) AS prior FROM tool_calls),
    n AS (SELECT generation_id, fingerprint, arg_max(status, id) AS status FROM tool_calls GROUP BY 1, 2),
    j AS (SELECT c.id, c.replay_policy, c.prior, n.status AS source FROM c JOIN runs r ON r.generation_id = c.generation_id LEFT JOIN n ON n.generation_id = r.retry_of AND n.fingerprint = c.fingerprint),
    e AS (SELECT id, replay_policy, prior, source, coalesce(prior, source) AS st FROM j)
    SELECT id, CASE WHEN prior IS NULL AND source = 'APPROVED' THEN 'EXECUTE' WHEN st IN ('REJECTED', 'SUCCESS', 'REUSED') THEN 'REUSE'
      WHEN replay_policy = 'AT_MOST_ONCE' AND st IN ('RUNNING', 'UNKNOWN', 'WAITING_APPROVAL') THEN 'BLOCK' WHEN prior IS NULL AND replay_policy = 'REQUIRES_APPROVAL' THEN 'BLOCK' ELSE 'EXECUTE' END AS disposition FROM e""")
def _tools(t):
    return limits.tool_ledger(t.tool_calls, t.runs).select("id", "disposition")


@query("k13_approvals", """WITH d AS (SELECT 2 * e.event_id + j AS decision_id, c.event_id AS call_id, CASE WHEN (e.event_id + j) % 3 = 0 THEN e.user_id ELSE c.user_id END AS user_id,
      e.value > 50 AS decision, c.user_id AS owner FROM events e, (SELECT unnest([0, 1]) AS j), (SELECT max(event_id) + 1 AS n FROM events) w, events c WHERE c.event_id = (e.event_id + 3 * j) % n),
    f AS (SELECT call_id, arg_min(decision, decision_id) AS decision, min(decision_id) AS id FROM d WHERE user_id = owner GROUP BY 1)
    SELECT d.decision_id, CASE WHEN d.user_id <> d.owner THEN 'FORBIDDEN' WHEN d.decision_id = f.id THEN 'APPLIED' WHEN d.decision = f.decision THEN 'IDEMPOTENT' ELSE 'CONFLICT' END AS outcome FROM d LEFT JOIN f ON f.call_id = d.call_id""")
def _approvals(t):
    # every event decides on two calls, so every call is decided on by two events
    calls = t.events.select(F.col("event_id").alias("call_id"), "user_id")
    n = t.events.select(F.max("event_id") + 1).scalar()
    each = t.events.select("event_id", "user_id", "value", F.explode(F.array(F.lit(0), F.lit(1))).alias("j")).withColumn("call_id", (F.col("event_id") + 3 * F.col("j")) % n)
    made = each.join(calls.withColumnRenamed("user_id", "_u"), "call_id")
    who = F.when((F.col("event_id") + F.col("j")) % 3 == 0, F.col("user_id")).otherwise(F.col("_u"))
    decisions = made.select((2 * F.col("event_id") + F.col("j")).alias("decision_id"), "call_id", who.alias("user_id"), (F.col("value") > 50).alias("decision"))
    return ledgers.approvals(calls, decisions).select("decision_id", "outcome")


@query("k17_history_ttl", f"SELECT generation_id, count(*) AS steps FROM steps WHERE generation_id IN (SELECT generation_id FROM steps GROUP BY 1 HAVING max(occurred_at) >= {_NOW} - INTERVAL 7 DAY) GROUP BY 1")
def _ttl(t):
    return ledgers.within_history(t.steps, "generation_id", "occurred_at", F.expr(_NOW)).groupBy("generation_id").agg(F.count("*").alias("steps"))


_MARK = "10::BIGINT * 60000000"


@query("k06_settlement_stream", f"""WITH r AS (SELECT event_id AS id, concat(CAST(user_id AS STRING), ':', CAST(CAST(ts AS DATE) AS VARCHAR)) AS quota_key, epoch_us(ts) AS us, CAST(round(value * 100, 0) AS BIGINT) AS reserved FROM events),
    o AS (SELECT event_id AS id, epoch_us(ts) + (event_id % 50) * 60000000 AS us, CASE WHEN event_id % 5 = 0 THEN 'abort' ELSE 'settle' END AS outcome, CAST(floor(round(value * 100, 0) * (80 + event_id % 50) / 100) AS BIGINT) AS actual FROM events WHERE event_id % 5 <> 1),
    w AS (SELECT least((SELECT max(us) FROM r), (SELECT max(us) FROM o)) // 1000 * 1000 - {_MARK} AS w)
    SELECT r.id, quota_key, reserved, coalesce(outcome, 'abort') AS outcome, o.id IS NULL AS timed_out, CASE WHEN outcome = 'settle' THEN actual ELSE 0 END AS final
    FROM r LEFT JOIN o ON o.id = r.id AND o.us >= r.us AND o.us <= r.us + 1800000000, w WHERE o.id IS NOT NULL OR r.us + 1800000000 < w""")
def _settle_stream(t):
    rows = requests(stream_of(t, "events"))
    quota_key = F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
    # outcomes come up to 49 minutes later; half an hour counts, and every fifth reservation has none
    outcomes = requests(stream_of(t, "events")).where("id % 5 <> 1").select(
        "id", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("id") % 50) * 60_000_000).alias("ts"),
        F.when(F.col("id") % 5 == 0, "abort").otherwise("settle").alias("outcome"), F.floor(F.col("reserved") * (80 + F.col("id") % 50) / 100).alias("actual"))
    return pipeline.drain(keyed.settlement_stream(rows.withColumn("quota_key", quota_key), outcomes, "30 MINUTES"), "settlement")


_QUIET = f"""q AS (SELECT generation_id, epoch_us(max(occurred_at)) AS last_us, arg_max(stage, id) AS stage FROM steps GROUP BY 1),
    w AS (SELECT epoch_us(max(ts)) // 1000 - 600000 AS w FROM events),
    found AS (SELECT generation_id, last_us, last_us // 1000 + 7200001 AS found_ms, w FROM q, w WHERE stage = 'view' AND last_us // 1000 + 7200001 <= w)"""


def step_stream(t):
    """Steps of runs as a stream, with the name that the bindings give a run."""
    rows = stream_of(t, "events")
    name = F.concat(F.lit("g"), F.col("user_id").cast("string"), F.lit("-"), F.floor(F.col("event_id") / 500).cast("string"))
    return rows.select(name.alias("generation_id"), F.col("event_id").alias("id"), "ts", F.col("event_type").alias("status"))


@query("k10_interrupted_runs_stream", f"WITH {_QUIET} SELECT generation_id, last_us, 'INTERRUPTED' AS new_status FROM found")
def _interrupted_stream(t):
    # nothing but time brings these rows about
    return pipeline.drain(keyed.interrupted_stream(step_stream(t), 120, ("view",)), "quiet").drop("found_at")


@query("k10_interrupted_daily_stream", f"""WITH {_QUIET} SELECT found_ms // 86400000 * 86400000000 AS day_us, count(*) AS runs FROM found GROUP BY found_ms // 86400000, w HAVING (found_ms // 86400000 + 1) * 86400000 <= w""")
def _interrupted_daily(t):
    # a second stateful operator behind the first: runs found quiet per day, when the day is over
    found = keyed.interrupted_stream(step_stream(t), 120, ("view",))
    daily = found.groupBy(F.window("found_at", "1 day").alias("w")).agg(F.count("*").alias("runs"))
    return pipeline.drain(daily.select(F.unix_micros("w.start").alias("day_us"), "runs"), "quiet-days")


@query("k11_pending_tasks_stream", """WITH e AS (SELECT user_id, event_id AS id, epoch_us(ts) AS us, event_type = 'signup' AS task FROM events WHERE event_type IN ('signup', 'click')),
    n AS (SELECT *, lead(us) OVER o AS next_us, lead(task) OVER o AS next_task FROM e WINDOW o AS (PARTITION BY user_id ORDER BY us, id)),
    w AS (SELECT max(us) // 1000 - 600000 AS w FROM e)
    SELECT user_id, id AS task_id, CASE WHEN next_us IS NULL OR us + 86400000000 < next_us THEN 'EXPIRED' WHEN next_task THEN 'REPLACED' ELSE 'RESUMED' END AS state,
      CASE WHEN next_us IS NULL OR us + 86400000000 < next_us THEN us + 86400000000 ELSE next_us END AS at_us
    FROM n, w WHERE task AND (next_us IS NOT NULL OR (us + 86400000000) // 1000 + 1 <= w)""")
def _pending_stream(t):
    rows = stream_of(t, "events").where("event_type IN ('signup', 'click')")
    events = rows.select("user_id", F.col("event_id").alias("id"), "ts", (F.col("event_type") == "signup").alias("is_task"), (micros("ts") + 86_400_000_000).alias("expires_us"))
    return pipeline.drain(keyed.pending_stream(events), "pending")


def task_rows(t, paths=None):
    """One JSON task per file, as the queue would carry it; every twelfth has no file id. ``paths`` (file_md5, filePath) tells where a file lies."""
    md5 = F.when(F.col("doc_id") % 12 == 5, "").otherwise(F.col("file_md5"))
    rows = t.files.join(paths, "file_md5", "left") if paths is not None else t.files.withColumn("filePath", F.lit(None).cast("string"))
    return rows.select("doc_id", F.to_json(F.struct(
        md5.alias("fileMd5"), "filePath", F.col("file_name").alias("fileName"), F.col("user_id").cast("string").alias("userId"), F.col("org_tag").alias("orgTag"),
        F.col("is_public").alias("isPublic"), F.lit("VECTORIZE").alias("taskType"))).alias("value"))


def task_stream(t, paths=None):
    """The tasks written as text files to the shared folder and read back as a stream."""
    path = pipeline.scratch_path(t.spark, "tasks")
    task_rows(t, paths).select("value").repartition(8).write.text(path)
    return pipeline.parse_tasks(pipeline.read_stream(t.spark, path, "value string", "text"))


@query("a04_task_stream", """SELECT file_md5, CAST(user_id AS VARCHAR) AS user_id, file_name, coalesce(org_tag, '-') AS org_tag, is_public, count(*) AS tasks FROM files WHERE doc_id % 12 <> 5 GROUP BY ALL""")
def _tasks(t):
    read = pipeline.drain(task_stream(t), "tasks")
    return read.where("valid").groupBy(F.col("fileMd5").alias("file_md5"), F.col("userId").alias("user_id"), F.col("fileName").alias("file_name"),
                                       F.coalesce("orgTag", F.lit("-")).alias("org_tag"), F.col("isPublic").alias("is_public")).agg(F.count("*").alias("tasks"))


@query("a05_retries_and_dead_letters", """SELECT 'done' AS outcome, CASE WHEN n_chars % 7 = 0 THEN 1 ELSE n_chars % 7 END AS attempt, count(*) AS tasks FROM files WHERE n_chars % 7 < 6 GROUP BY 2
    UNION ALL SELECT 'dead', 5, count(*) FROM files WHERE n_chars % 7 = 6""")
def _retries(t):
    # a task works at the attempt its length says: 1 to 5; those that would need a sixth are dead
    def work(rows):
        return rows.withColumn("ok", F.col("attempt") >= F.col("n_chars") % 7)

    tasks = stream_of(t, "documents").select("doc_id", "n_chars")
    done, dead = retries.drain_with_retries(tasks, work, pipeline.scratch_path(t.spark, "retries"))
    both = done.withColumn("outcome", F.lit("done")).unionByName(dead.withColumn("outcome", F.lit("dead")))
    return both.groupBy("outcome", "attempt").agg(F.count("*").alias("tasks"))


@query("a06_index_sink", "SELECT file_md5, count(*) AS documents FROM files GROUP BY 1")
def _index(t):
    index = SegmentIndex(t.spark, pipeline.scratch_path(t.spark, "index"), spread_by=("doc_id",))
    rows = t.files.select("file_md5", "doc_id", "file_name")
    index.upsert(rows, "first")
    # writing some files again replaces their rows and keeps all others
    some = rows.where("doc_id % 5 = 0").select("file_md5").distinct()
    index.upsert(rows.join(some, "file_md5", "left_semi"), "again")
    return index.read().groupBy("file_md5").agg(F.count("*").alias("documents"))


@query("a07_index_delete_marks", """SELECT file_md5, count(*) AS documents, CAST(sum(CASE WHEN file_md5 IN (SELECT file_md5 FROM files WHERE status = 0) THEN 2 ELSE 1 END) AS BIGINT) AS versions
    FROM files WHERE file_md5 NOT IN (SELECT file_md5 FROM files WHERE status = 2) OR file_md5 IN (SELECT file_md5 FROM files WHERE status = 0) GROUP BY 1""")
def _marks(t):
    index = SegmentIndex(t.spark, pipeline.scratch_path(t.spark, "marks"), spread_by=("doc_id",))
    rows = t.files.select("file_md5", "doc_id", F.lit(1).alias("version"))
    index.upsert(rows, "first")
    index.delete(t.files.where("status = 2"), "deleted")
    # what is written after its deletion is there again
    index.upsert(rows.withColumn("version", F.lit(2)).join(t.files.where("status = 0").select("file_md5").distinct(), "file_md5", "left_semi"), "again")
    index.compact(fan=2)
    return index.read().groupBy("file_md5").agg(F.count("*").alias("documents"), F.sum("version").alias("versions"))


@query("a09_retrieval_golden_set", "SELECT CAST(query_id AS VARCHAR) AS case_id, CAST(doc_id AS VARCHAR) AS document_id FROM qrels")
def _golden(t):
    path = pipeline.scratch_path(t.spark, "golden")
    packed = t.qrels.groupBy("query_id").agg(F.collect_set(F.col("doc_id").cast("string")).alias("relevantDocumentIds"))
    rows = packed.join(t.questions, "query_id").select(F.col("query_id").cast("string").alias("id"), F.col("text").alias("query"), "relevantDocumentIds", F.lit(10).alias("topK"))
    rows.write.json(path)
    return golden.read_retrieval_golden(t.spark, path)[1]


@query("a10_agent_golden_set", """SELECT concat('u', CAST(user_id AS STRING)) AS "caseId", CAST(row_number() OVER (PARTITION BY user_id ORDER BY generation_id) AS INT) AS "attemptIndex", status = 'COMPLETED' AS passed, CAST(prompt_tokens AS INT) AS prompt_tokens FROM runs""")
def _attempts(t):
    from pyspark.sql import Window

    path = pipeline.scratch_path(t.spark, "attempts")
    none = F.array().cast("array<string>")
    order = Window.partitionBy("user_id").orderBy("generation_id")
    attempt = F.struct(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("caseId"), F.row_number().over(order).cast("int").alias("attemptIndex"), none.alias("expectedTrajectory"),
        none.alias("actualTrajectory"), (F.col("status") == "COMPLETED").alias("passed"), F.struct(F.col("prompt_tokens").cast("int").alias("promptTokens")).alias("signals"))
    # one golden document per run; a document of the format holds a list of attempts
    t.runs.select(F.array(attempt).alias("attempts")).write.json(path)
    return golden.read_agent_golden(t.spark, path, one_document_per_file=False).select("caseId", "attemptIndex", "passed", F.col("signals.promptTokens").alias("prompt_tokens"))


@query("k14_ingestion_stream", """SELECT file_md5, CAST(user_id AS VARCHAR) AS user_id, 'COMPLETED' AS status FROM (SELECT DISTINCT f.file_md5, f.user_id FROM files f JOIN documents d ON d.doc_id = f.doc_id
    WHERE f.doc_id % 12 <> 5 AND length(trim(d.text)) > 0)""")
def _ingest(t):
    # every file is stored as such, and its tasks name it
    store = pipeline.scratch_path(t.spark, "store")
    texts = t.documents.select(F.md5("text").alias("name"), "text").dropDuplicates(["name"])
    paths = write_files(texts, store).withColumnRenamed("name", "file_md5")
    base = pipeline.scratch_path(t.spark, "ingestion")
    pipeline.ingestion_stream(task_stream(t, paths), None, base).awaitTermination()
    return pipeline.statuses(t.spark, base).select("file_md5", "user_id", "status")


def _gates_sql():
    """The report of ``_agent_gates`` by hand: what is expected there leaves few terms in every metric."""
    values = {
        "clarification_f1": r4("CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END"),
        "intent_macro_f1": r4("CASE WHEN v = 0 THEN 0 ELSE 2.0::DOUBLE * v / (v + n) END / (1 + CASE WHEN c > 0 THEN 1 ELSE 0 END)"),
        "evidence_status_macro_f1": "CASE WHEN es > 0 THEN 0 ELSE 1 END", "conflict_detection_f1": "CASE WHEN cf > 0 THEN 0 ELSE 1 END",
        "trajectory_score": r4("0.5::DOUBLE * tr / n"), "invalid_transition_rate": "1", "tool_selection_f1": "1", "tool_argument_accuracy": "1", "citation_f1": "1", "claim_coverage": "1",
        "duplicate_action_rate": r4("CASE WHEN tot = 0 THEN 0 ELSE dup::DOUBLE / tot END"), "terminal_reason_accuracy": r4("done::DOUBLE / n"),
        "resume_success_rate": r4("CASE WHEN tries = 0 THEN 1 ELSE won::DOUBLE / tries END"), "duplicate_side_effect_rate": r4("CASE WHEN greatest(wr, side) = 0 THEN 0 ELSE side::DOUBLE / greatest(wr, side) END"),
        "pass_power_k": r4("done::DOUBLE / n"),
    }
    rows = " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({values[m]} AS DOUBLE) AS value, CAST({bound} AS DOUBLE) AS threshold, {str(low).lower()} AS is_minimum FROM q" for m, bound, low in E.AGENT_GATES)
    return f"""WITH {SIGNALS}, a AS (SELECT s.*, r.status FROM signals s JOIN runs r USING (generation_id)),
    k AS (SELECT count(*) AS n, count(*) FILTER (intent = 'view') AS v, count(*) FILTER (intent = 'click') AS c, count(*) FILTER (evidence_status <> '') AS es, count(*) FILTER (conflict) AS cf,
      count(*) FILTER (intent = 'view' AND conflict) AS tp, count(*) FILTER (intent <> 'view' AND conflict) AS fp, count(*) FILTER (intent = 'view' AND NOT conflict) AS fn,
      count(*) FILTER (intent = 'view' OR evidence_status = 'signup') AS tr, sum(duplicate_actions) AS dup, sum(total_actions) AS tot, count(*) FILTER (status = 'COMPLETED') AS done,
      count(*) FILTER (recovery_attempt) AS tries, count(*) FILTER (recovery_attempt AND recovered) AS won, sum(duplicate_side_effects) AS side, sum(write_actions) AS wr FROM a),
    q AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1 ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1 ELSE tp::DOUBLE / (tp + fn) END AS r FROM k),
    g AS ({rows}), h AS (SELECT *, CASE WHEN is_minimum THEN value >= threshold ELSE value <= threshold END AS passed FROM g)
    SELECT *, (SELECT bool_and(passed) FROM h) AS gate_passed FROM h"""


@query("g14_agent_gates", _gates_sql())
def _agent_gates(t):
    from corpuscope.plans.evaluation import signals

    stages = F.array(F.lit("signup"), F.lit("view"))
    rows = signals(t).join(t.runs.select("generation_id", "user_id", "attempt", "status"), "generation_id")
    tools = F.array().cast("array<struct<name:string,argumentsFingerprint:string>>")
    none = F.array().cast("array<string>")
    attempts = rows.select(
        F.col("generation_id").alias("caseId"), F.lit(1).alias("attemptIndex"), (F.col("intent") == "view").alias("expectedClarification"), F.col("conflict").alias("actualClarification"),
        none.alias("expectedClarificationSlots"), none.alias("actualClarificationSlots"), stages.alias("expectedTrajectory"), F.array("intent", "evidence_status").alias("actualTrajectory"),
        tools.alias("expectedTools"), tools.alias("actualTools"), none.alias("expectedCitationIds"), none.alias("actualCitationIds"), none.alias("requiredClaimIds"), none.alias("supportedClaimIds"),
        F.col("duplicate_actions").alias("duplicateActionCount"), F.col("total_actions").alias("totalActionCount"), F.lit("answered").alias("expectedTerminalReason"),
        F.when(F.col("status") == "COMPLETED", "ANSWERED").otherwise("no_progress").alias("actualTerminalReason"), (F.col("status") == "COMPLETED").alias("passed"),
        F.struct(F.lit("view").alias("expectedIntent"), F.col("intent").alias("actualIntent"), F.lit("").alias("expectedEvidenceStatus"), F.col("evidence_status").alias("actualEvidenceStatus"),
                 F.lit(False).alias("expectedConflict"), F.col("conflict").alias("actualConflict"), F.col("recovery_attempt").alias("recoveryAttempt"), F.col("recovered").alias("recoverySucceeded"),
                 F.col("duplicate_side_effects").alias("duplicateSideEffectCount"), F.col("write_actions").alias("writeActionCount"), F.col("latency_ms").alias("latencyMs"),
                 F.col("prompt_tokens").alias("promptTokens"), F.col("completion_tokens").alias("completionTokens")).alias("signals"))
    return E.gate(cut_lineage(E.agent_report(attempts)), E.AGENT_GATES)

