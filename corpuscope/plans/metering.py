"""Usage, guard, window, sort and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.functions.times import millis
from corpuscope.operators import access, fuse, guards, listing, usage
from corpuscope.plans import fragments as sql
from corpuscope.plans.lists import LATEST
from corpuscope.plans.registry import query
from corpuscope.plans.retrieval import FUSED, lists_of

_DAY = "CAST(record_date AS VARCHAR) AS day"


def day(df):
    return df.withColumn("day", F.col("record_date").cast("string")).drop("record_date")


def booked(t):
    return t.ledger.withColumn("request_count", F.lit(1))


@query("g01_daily_token_use", f"""SELECT {_DAY}, CAST(sum(amount) AS BIGINT) AS amount, count(*) AS requests FROM ledger WHERE change_type = 'CONSUME' AND token_type = 'LLM'
    AND record_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' GROUP BY record_date""")
def _daily(t):
    return day(usage.daily_usage(booked(t), "LLM", "2024-01-03", "2024-01-25"))


@query("g02_daily_chat_count", f"SELECT {_DAY}, count(*) AS count FROM ledger GROUP BY record_date")
def _chats(t):
    return day(usage.daily_counts(t.ledger.groupBy("user_id", "record_date").agg(F.count("*").alias("count"))))


@query("g03_gap_free_trend", """WITH spine AS (SELECT CAST(DATE '2023-12-20' + CAST(i AS INT) AS DATE) AS d FROM (SELECT unnest(range(0, 30)) AS i)),
    a AS (SELECT record_date, CAST(sum(amount) FILTER (token_type = 'LLM') AS BIGINT) AS llm, CAST(sum(amount) FILTER (token_type = 'EMBEDDING') AS BIGINT) AS emb FROM ledger WHERE change_type = 'CONSUME' GROUP BY 1),
    c AS (SELECT record_date, count(*) AS n FROM ledger GROUP BY 1)
    SELECT CAST(d AS VARCHAR) AS day, coalesce(llm, 0) AS llm, coalesce(emb, 0) AS embedding, coalesce(n, 0) AS chats FROM spine LEFT JOIN a ON a.record_date = d LEFT JOIN c ON c.record_date = d""")
def _trend(t):
    spent = booked(t)
    series = {name: usage.daily_usage(spent, kind, "2023-12-20", "2024-01-18").withColumnRenamed("amount", "value")
              for name, kind in (("llm", "LLM"), ("embedding", "EMBEDDING"))}
    series["chats"] = t.ledger.groupBy("record_date").agg(F.count("*").alias("value"))
    return day(usage.trend("2023-12-20", 30, t.ledger, series))


@query("g04_sum_with_default", """WITH w AS (SELECT DISTINCT user_id, k.token_type, k.change_type FROM ledger, (SELECT DISTINCT token_type, change_type FROM ledger) k)
    SELECT w.user_id, w.token_type, w.change_type, CAST(coalesce(sum(l.amount), 0) AS BIGINT) AS total FROM w LEFT JOIN ledger l USING (user_id, token_type, change_type) GROUP BY ALL""")
def _totals(t):
    kinds = F.explode(F.array(*[F.struct(F.lit(a).alias("token_type"), F.lit(b).alias("change_type")) for a in ("LLM", "EMBEDDING") for b in ("CONSUME", "INCREASE")]))
    wanted = t.ledger.select("user_id").distinct().select("user_id", kinds.alias("k")).select("user_id", "k.*")
    return usage.totals_by_kind(t.ledger, wanted)


_BALANCE = """bal AS (SELECT *, CASE WHEN user_id % 25 = 3 THEN 100000 ELSE 50000 END + sum(CASE WHEN change_type = 'INCREASE' THEN amount ELSE -amount END)
    OVER (PARTITION BY user_id, token_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS balance_after FROM ledger)"""


def balances(t):
    grants = t.ledger.select("user_id", "token_type").distinct().withColumn("initial", F.when(F.col("user_id") % 25 == 3, 100000).otherwise(50000))
    return usage.running_balance(t.ledger, grants)


@query("g05_daily_rollup", f"""WITH {_BALANCE}, b AS (SELECT *, balance_after + amount AS balance_before FROM bal WHERE change_type = 'CONSUME')
    SELECT user_id, token_type, {_DAY}, CAST(sum(amount) AS BIGINT) AS amount, count(*) AS requests, CAST(arg_min(balance_before, event_id) AS BIGINT) AS balance_before, CAST(arg_max(balance_after, event_id) AS BIGINT) AS balance_after
    FROM b GROUP BY user_id, record_date, token_type""")
def _rollup(t):
    return day(usage.daily_rollup(balances(t).withColumn("balance_before", F.col("balance_after") + F.col("amount"))))


@query("g06_running_balance", f"WITH {_BALANCE} SELECT event_id, user_id, token_type, CAST(balance_after AS BIGINT) AS balance_after FROM bal")
def _balance(t):
    return balances(t).select("event_id", "user_id", "token_type", "balance_after")


VIEW = """qv AS (SELECT user_id, token_type AS scope, CAST(sum(amount) AS BIGINT) AS used, CASE token_type WHEN 'LLM' THEN 250000 ELSE 90000 END AS limit_tokens,
    CAST(greatest(CASE token_type WHEN 'LLM' THEN 250000 ELSE 90000 END - sum(amount), 0) AS BIGINT) AS remaining, count(*) AS requests FROM ledger WHERE change_type = 'CONSUME' GROUP BY 1, 2)"""


def quota(t):
    limits = t.ledger.select(F.col("token_type").alias("scope")).distinct().withColumn("day_max_tokens", F.when(F.col("scope") == "LLM", 250000).otherwise(90000))
    return usage.quota_view(t.ledger, limits)


@query("g07_quota_view", f"WITH {VIEW} SELECT * FROM qv")
def _quota(t):
    return quota(t)


@query("g08_quota_alerts", f"""WITH {VIEW} SELECT user_id, scope, CASE WHEN remaining <= 0 THEN 'critical' ELSE 'warning' END AS level, round(used::DOUBLE / limit_tokens, 4) AS ratio, used, limit_tokens
    FROM qv WHERE remaining <= 0 OR used::DOUBLE / limit_tokens >= 0.8""")
def _alerts(t):
    return usage.quota_alerts(quota(t)).orderBy(*usage.alert_order())


@query("g08_balance_alerts", f"""WITH {_BALANCE}, b AS (SELECT *, balance_after + amount AS balance_before FROM bal WHERE change_type = 'CONSUME'),
    r AS (SELECT user_id, token_type, record_date, arg_min(balance_before, event_id) AS b0, arg_max(balance_after, event_id) AS b1 FROM b GROUP BY 1, 2, 3)
    SELECT user_id, token_type, {_DAY}, CASE WHEN b1 <= 0 THEN 'critical' ELSE 'warning' END AS level, round(CASE WHEN b0 > 0 THEN b1::DOUBLE / b0 ELSE 0 END, 4) AS remaining_ratio
    FROM r WHERE b1 <= 0 OR CASE WHEN b0 > 0 THEN b1::DOUBLE / b0 ELSE 0 END <= 1 - 0.8::DOUBLE""")
def _balance_alerts(t):
    rollup = usage.daily_rollup(balances(t).withColumn("balance_before", F.col("balance_after") + F.col("amount")))
    return day(usage.balance_alerts(rollup)).select("user_id", "token_type", "day", "level", "remaining_ratio")


@query("g09_top_consumers", """SELECT scope, user_id, used, rank FROM (SELECT token_type AS scope, user_id, CAST(sum(amount) AS BIGINT) AS used, row_number() OVER (PARTITION BY token_type ORDER BY sum(amount) DESC, user_id) AS rank
    FROM ledger WHERE change_type = 'CONSUME' AND record_date = DATE '2024-01-15' GROUP BY 1, 2 HAVING sum(amount) > 0) WHERE rank <= 5""")
def _top(t):
    return usage.top_consumers(t.ledger, "2024-01-15")


@query("h01_final_rank", f"""WITH RECURSIVE {sql.EFFECTIVE}, {sql.bm25('questions', 'docs', acl=True)} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm_scores""")
def _ranks(t):
    from pyspark.sql import Window

    from corpuscope.operators.bm25 import bm25_scores
    from corpuscope.plans.retrieval import asked

    scored = bm25_scores(asked(t), t.docs)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return scored.select("query_id", "doc_id", F.row_number().over(w).alias("rank"))


@query("h02_latest_per_key", f"WITH {LATEST} SELECT generation_id, step_id, id FROM latest")
def _latest(t):
    return listing.latest_steps(t.steps.select("id", "generation_id", "step_id"))


ACTIONS = "acts AS (SELECT id, generation_id, tool AS fingerprint, row_number() OVER (PARTITION BY generation_id, tool ORDER BY id) AS n FROM tool_calls)"


@query("h03_repeated_actions", f"""WITH {ACTIONS} SELECT id, generation_id, least(n, 3) AS occurrence, CASE WHEN n >= 3 THEN 'BLOCK' WHEN n = 2 THEN 'WARN' ELSE 'ALLOW' END AS disposition FROM acts""")
def _repeats(t):
    actions = t.tool_calls.select("id", "generation_id", F.col("tool").alias("fingerprint"))
    return guards.repeated_actions(actions).select("id", "generation_id", "occurrence", "disposition")


@query("h04_stagnation", """WITH r AS (SELECT generation_id, id AS seq, CASE WHEN stage = 'signup' THEN ' ' ELSE CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END END AS signature FROM steps),
    l AS (SELECT *, lag(signature) OVER (PARTITION BY generation_id ORDER BY seq) AS p FROM r WHERE trim(signature) <> ''),
    i AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> signature THEN 1 ELSE 0 END) OVER (PARTITION BY generation_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM l),
    s AS (SELECT generation_id, seq, row_number() OVER (PARTITION BY generation_id, island ORDER BY seq) - 1 AS stagnant_rounds FROM i)
    SELECT *, stagnant_rounds >= 2 AS stop FROM s""")
def _stagnation(t):
    signature = F.when(F.col("stage") == "signup", " ").when(F.col("k") % 2 == 0, "even").otherwise("odd")
    rounds = t.steps.select("generation_id", F.col("id").alias("seq"), signature.alias("signature"))
    return guards.stagnation(rounds).drop("signature")


_KIND = "CASE WHEN stage IN ('click', 'purchase', 'error') THEN 'TOOL' WHEN stage = 'view' THEN 'MODEL_WITH_TOOLS' ELSE 'MODEL' END"


_BUDGET = f"""s AS (SELECT generation_id, id, {_KIND} AS kind, epoch_ms(occurred_at) - min(epoch_ms(occurred_at)) OVER (PARTITION BY generation_id) AS ms, k, 2 * k AS c,
      row_number() OVER (PARTITION BY generation_id ORDER BY id) AS n FROM steps),
    ok AS (SELECT 1 AS x),
    fold AS (SELECT s.*, 0 AS turns, 0 AS tools, 0 AS p, 0 AS q, CASE WHEN ms >= 40000000 THEN 'TIME_BUDGET_EXHAUSTED' ELSE 'ALLOWED' END AS decision FROM s WHERE n = 1
      UNION ALL SELECT generation_id, id, kind, ms, k, c, n, turns, tools, p, q, CASE WHEN ms >= 40000000 THEN 'TIME_BUDGET_EXHAUSTED' WHEN p >= 120 OR q >= 300 THEN 'TOKEN_BUDGET_EXHAUSTED'
        WHEN kind = 'TOOL' AND tools >= 2 THEN 'TOOL_BUDGET_EXHAUSTED' WHEN kind = 'MODEL_WITH_TOOLS' AND turns >= 1 THEN 'ROUND_BUDGET_EXHAUSTED' WHEN kind = 'MODEL' AND turns >= 2 THEN 'ROUND_BUDGET_EXHAUSTED' ELSE 'ALLOWED' END
      FROM (SELECT s.*, f.turns + CASE WHEN f.decision = 'ALLOWED' AND f.kind <> 'TOOL' THEN 1 ELSE 0 END AS turns, f.tools + CASE WHEN f.decision = 'ALLOWED' AND f.kind = 'TOOL' THEN 1 ELSE 0 END AS tools,
        f.p + CASE WHEN f.decision = 'ALLOWED' AND f.kind <> 'TOOL' THEN f.k ELSE 0 END AS p, f.q + CASE WHEN f.decision = 'ALLOWED' AND f.kind <> 'TOOL' THEN f.c ELSE 0 END AS q
        FROM fold f JOIN s ON s.generation_id = f.generation_id AND s.n = f.n + 1) nx)"""


@query("h05_run_budgets", f"WITH RECURSIVE {_BUDGET} SELECT id, decision FROM fold")
def _budget(t):
    # tight limits, so that the short runs of this table reach them
    start = t.steps.groupBy("generation_id").agg(F.min(millis("occurred_at")).alias("_s"))
    actions = t.steps.join(start, "generation_id").select(
        "generation_id", "id", F.expr(_KIND).alias("kind"), (millis("occurred_at") - F.col("_s")).alias("elapsed_ms"),
        F.col("k").cast("long").alias("prompt_tokens"), (F.col("k") * 2).cast("long").alias("completion_tokens"))
    return guards.budget_decisions(actions, turns=2, tools=2, prompt=120, completion=300, seconds=40000).select("id", "decision")


@query("h05_token_time_budget", """SELECT id, CASE WHEN elapsed_ms >= 40000000 THEN 'TIME_BUDGET_EXHAUSTED' WHEN before >= 120 THEN 'TOKEN_BUDGET_EXHAUSTED' ELSE 'ALLOWED' END AS decision FROM (
    SELECT id, epoch_ms(occurred_at) - min(epoch_ms(occurred_at)) OVER (PARTITION BY generation_id) AS elapsed_ms,
      coalesce(sum(k) OVER (PARTITION BY generation_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM steps)""")
def _token_budget(t):
    # every action is a model turn and turns do not run out: only time and tokens decide
    start = t.steps.groupBy("generation_id").agg(F.min(millis("occurred_at")).alias("_s"))
    actions = t.steps.join(start, "generation_id").select(
        "generation_id", "id", F.lit("MODEL").alias("kind"), (millis("occurred_at") - F.col("_s")).alias("elapsed_ms"),
        F.col("k").cast("long").alias("prompt_tokens"), F.lit(0).cast("long").alias("completion_tokens"))
    return guards.budget_decisions(actions, turns=10**6, prompt=120, seconds=40000).select("id", "decision")


@query("h06_batch_cutoff", """SELECT id, CASE WHEN id > (SELECT min(s.id) FROM steps s WHERE s.generation_id = t.generation_id AND (s.stage = 'error' OR s.k > 80)) THEN 'CANCELLED_BY_RUNTIME' ELSE 'EXECUTED' END AS outcome FROM steps t""")
def _cutoff(t):
    calls = t.steps.select(F.col("generation_id").alias("batch_id"), F.col("id").alias("pos"), (F.col("stage") == "error").alias("terminal"), (F.col("k") > 80).alias("streamed"))
    return guards.batch_cutoff(calls).select(F.col("pos").alias("id"), "outcome")


@query("h07_turn_history", """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 20""")
def _recent(t):
    rows = t.events.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("pos"))
    return guards.recent_history(rows).select(F.col("conv_id").alias("user_id"), F.col("pos").alias("event_id"))


@query("h08_message_history", """WITH q AS (SELECT a.conv_id, a.pos, a.content AS question, b.content AS answer FROM messages a JOIN messages b ON b.conv_id = a.conv_id AND b.pos = a.pos + 1 AND b.role = 'assistant' WHERE a.role = 'user')
    SELECT conv_id, pos * 2 AS seq, 'user' AS role, question AS content FROM q UNION ALL SELECT conv_id, pos * 2 + 1, 'assistant', answer FROM q""")
def _messages(t):
    answers = t.messages.where("role = 'assistant'").select("conv_id", (F.col("pos") - 1).alias("pos"), F.col("content").alias("answer"))
    turns = t.messages.where("role = 'user'").select("conv_id", "pos", F.col("content").alias("question")).join(answers, ["conv_id", "pos"])
    both = F.explode(F.array(F.struct((F.col("pos") * 2).alias("seq"), F.lit("user").alias("role"), F.col("question").alias("content")),
                             F.struct((F.col("pos") * 2 + 1).alias("seq"), F.lit("assistant").alias("role"), F.col("answer").alias("content"))))
    return turns.select("conv_id", both.alias("m")).select("conv_id", "m.*")


@query("i01_multi_key_sort", f"{FUSED} SELECT query_id, doc_id, rank FROM ({sql.topk('fused', 40, score='rrf_score')}) x")
def _sort(t):
    return fuse.rrf(lists_of(t), 40).select("query_id", "doc_id", "rank").orderBy("query_id", "rank")


@query("i02_newest_rows", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def _newest(t):
    return t.events.select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@query("i03_page_slice", """SELECT order_id, amount_cents, (SELECT count(*) FROM recharge_orders) AS total, CAST(ceil((SELECT count(*) FROM recharge_orders) / 20.0) AS BIGINT) AS pages FROM recharge_orders ORDER BY amount_cents DESC, order_id LIMIT 20 OFFSET 40""")
def _slice(t):
    return listing.page(t.recharge_orders, [F.desc("amount_cents"), F.asc("order_id")], 3, 20).select("order_id", "amount_cents", "total", "pages")


@query("i04_union_all", f"{FUSED} SELECT query_id, doc_id, channel, rank FROM lists")
def _union(t):
    return lists_of(t).select("query_id", "doc_id", "channel", "rank")


@query("i05_intersect", "SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup'")
def _intersect(t):
    return t.events.where("event_type = 'purchase'").select("user_id").intersect(t.events.where("event_type = 'signup'").select("user_id"))


@query("i06_except", "SELECT l_partkey AS part FROM lineitem WHERE l_quantity > 10 EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09")
def _except(t):
    return t.lineitem.where("l_quantity > 10").select(F.col("l_partkey").alias("part")).subtract(t.lineitem.where("l_discount > 0.09").select(F.col("l_partkey").alias("part")))


@query("i07_distinct_first", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def _distinct(t):
    return access.first_rows(t.events.select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.asc("event_id")])


@query("k03_clock_counters", "SELECT CAST(record_date AS VARCHAR) AS day, user_id, count(*) AS requests, CAST(sum(amount) AS BIGINT) AS tokens FROM ledger WHERE record_date >= DATE '2024-02-10' - 35 GROUP BY record_date, user_id")
def _counters(t):
    counters = usage.clock_counters(t.ledger).withColumn("record_date", F.col("window_start").cast("date")).drop("window_start")
    return day(usage.within_retention(counters, F.lit("2024-02-10").cast("date")))


@query("k06_settlement", """WITH o AS (SELECT event_id AS id, user_id, record_date, amount AS reserved, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'abort' WHEN 1 THEN NULL ELSE 'settle' END AS outcome, CAST(amount * (80 + event_id % 50) / 100 AS BIGINT) AS actual FROM ledger),
    f AS (SELECT *, CASE outcome WHEN 'settle' THEN floor(reserved * (80 + id % 50) / 100) WHEN 'abort' THEN 0 ELSE reserved END AS final FROM o)
    SELECT concat(CAST(user_id AS STRING), ':', CAST(record_date AS VARCHAR)) AS quota_key, CAST(sum(reserved) AS BIGINT) AS reserved, CAST(sum(final) AS BIGINT) AS used, count(*) FILTER (outcome = 'settle') AS settled,
      count(*) FILTER (outcome = 'abort') AS aborted, 20000 AS limit_tokens, sum(final) > 20000 AS overrun FROM f GROUP BY user_id, record_date""")
def _settle(t):
    key = F.concat_ws(":", F.col("user_id").cast("string"), F.col("record_date").cast("string"))
    reserved = t.ledger.select(F.col("event_id").alias("id"), key.alias("quota_key"), F.col("amount").alias("reserved"), F.lit(20000).alias("limit_tokens"))
    outcome = F.when(F.col("event_id") % 5 == 0, "abort").otherwise("settle")
    actual = F.floor(F.col("amount") * (80 + F.col("event_id") % 50) / 100)
    outcomes = t.ledger.where("event_id % 5 <> 1").select(F.col("event_id").alias("id"), outcome.alias("outcome"), actual.alias("actual"))
    return usage.settle(reserved, outcomes)
