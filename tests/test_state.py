"""Order-dependent operators against one-event-at-a-time folds, also for the ways taken by hot keys."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.functions.times import micros
from corpuscope.operators import context, guards, ledgers, limits, memory, usage
from corpuscope.streaming import keyed, pipeline, state

START = dt.datetime(2024, 1, 1)


def events(rng, keys=4, n=400, spread=2000):
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 1, 5, 30, 90]) if rng.random() < 0.9 else spread
        rows.append(("k%d" % (0 if rng.random() < 0.5 else rng.randrange(keys)), i, START + dt.timedelta(seconds=t, milliseconds=rng.randrange(3) * 0), rng.random() < 0.6, rng.randint(1, 40)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, id long, ts timestamp, failed boolean, amount long")


def us(ts):
    return int((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def fold(rows, start, step):
    states, out = {}, {}
    for key, id_, ts, failed, amount in sorted(rows, key=lambda r: (r[2], r[1])):
        out[id_], states[key] = step(states.get(key, start), us(ts), failed, amount)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_window_limit_equals_fold(spark, seed):
    rows = events(random.Random(seed))
    got = {r["id"]: r["accepted"] for r in limits.fixed_window_limit(frame(spark, rows), 5, 60).collect()}
    assert got == fold(rows, (0, 0), lambda s, t, f, a: limits.limiter_step(s, t, 5, 60))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_hot_key_is_walked_over_blocks(spark, seed, monkeypatch):
    """Nine rows in ten belong to one key; it is cut into blocks of four windows, and the starts are those of the plain walk."""
    rng = random.Random(seed)
    times = sorted(rng.choice([rng.randrange(0, 40_000), rng.randrange(10_000, 12_000), 20_000 + 60 * rng.randrange(100)]) for _ in range(3_000))
    rows = [("hot" if rng.random() < 0.9 else f"k{rng.randrange(3)}", i, START + dt.timedelta(seconds=t), False, 1) for i, t in enumerate(times)]
    df = frame(spark, rows)
    plain = sorted(map(tuple, limits.window_starts(df, 60).collect()))
    read, blocks = [], limits._starts_over_blocks
    monkeypatch.setattr(limits, "_starts_over_blocks", lambda t, seconds: read.append(t) or blocks(t, seconds, windows=4))
    assert sorted(map(tuple, limits.window_starts(df, 60, hot_points=200).collect())) == plain
    assert read[0].select("key").distinct().count() >= 1 and {r["key"] for r in read[0].collect()} >= {"hot"}
    # no block of the hot key holds over a tenth of its rows but where time itself is that dense
    sizes = [r["count"] for r in read[0].where("key = 'hot'").groupBy(F.floor(F.col("t") / (4 * 60_000_000))).count().collect()]
    assert max(sizes) <= sum(sizes) / 10


def test_quantiles_by_refined_bins(spark, monkeypatch):
    from corpuscope.operators.quantiles import exact_quantile

    rng = random.Random(5)
    groups = {"distinct": random.Random(1).sample(range(10**12), 3_000), "same": [7] * 50, "two": [-5, 10**15], "one": [3], "none": [None, None], "neg": [-rng.randrange(10**9) for _ in range(777)]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "g string, v long").repartition(5)
    for q in (0.5, 0.95, 1.0):
        want = {}
        for k, vs in groups.items():
            vs = sorted(v for v in vs if v is not None)
            if vs:
                want[k] = next(v for i, v in enumerate(vs) if (i + 1) / len(vs) >= q)
        got = exact_quantile(df, ["g"], F.col("v"), q, "x", bins=16, narrow=4)
        assert {r["g"]: r["x"] for r in got.collect()} == want
        assert {r["g"]: r["x"] for r in exact_quantile(df, ["g"], F.col("v"), q, "x", narrow=10**16).collect()} == want  # the built-in one
    every = sorted(v for vs in groups.values() for v in vs if v is not None)
    assert exact_quantile(df, [], F.col("v"), 0.95, "x").first()["x"] == next(v for i, v in enumerate(every) if (i + 1) / len(every) >= 0.95)


def test_rejected_call_is_told_when_to_retry(spark):
    rows = [("k", i, START + dt.timedelta(seconds=s), False, 1) for i, s in enumerate((0, 10, 20, 59, 60))]
    out = {r["id"]: (r["accepted"], r["retry_after"]) for r in limits.fixed_window_limit(frame(spark, rows), 2, 60).collect()}
    assert out == {0: (True, None), 1: (True, None), 2: (False, 40), 3: (False, 1), 4: (True, None)}


def test_dual_limit_charges_the_day_only_for_accepted(spark):
    rows = events(random.Random(5))
    got = {r["id"]: r["verdict"] for r in limits.dual_window_limit(frame(spark, rows), 3, 60, 10, 3600).collect()}

    def step(s, t, f, a):
        ok, m = limits.limiter_step(s[0], t, 3, 60)
        if not ok:
            return "MINUTE_LIMIT", (m, s[1])
        ok, d = limits.limiter_step(s[1], t, 10, 3600)
        return ("ACCEPTED" if ok else "DAY_LIMIT"), (m, d)

    assert got == fold(rows, ((0, 0), (0, 0)), step)


@pytest.mark.parametrize("fold_rows, block_rows, pieces", [(1_000_000, 9, 9), (40, 16, 1_024), (5, 7, 3), (5, 1, 1_024)])
def test_admission_equals_fold(spark, monkeypatch, fold_rows, block_rows, pieces):
    blocks = context._admit_blocks
    monkeypatch.setattr(context, "_admit_blocks", lambda rows, key, first, size: blocks(rows, key, first, size, pieces))
    rows = events(random.Random(9))
    df = frame(spark, rows).withColumn("cap", F.lit(300))
    out = context.admit(df, ["key"], F.col("id"), "amount", "cap", fold_rows=fold_rows, block_rows=block_rows)
    assert set(out.columns) == {*df.columns, "admitted"} and out.count() == len(rows)
    got = {r["id"]: r["admitted"] for r in out.collect()}
    assert got == fold(rows, 0, lambda s, t, f, a: limits.reserve_step(s, a, 300))


def test_maps_of_blocks_tell_what_is_left():
    rng = random.Random(2)
    for _ in range(60):
        most = rng.choice([20, 1_000])
        amounts = [rng.choice([0, 1, rng.randrange(30), rng.randrange(most)]) for _ in range(rng.randrange(1, 30))]
        breaks, shifts = np.array([np.iinfo(np.int64).min // 2]), np.zeros(1, np.int64)
        for a in amounts:
            breaks, shifts = context.after(breaks, shifts, a, most)
        for x in [-3, 0, most, *(rng.randrange(most + 1) for _ in range(20))]:
            left = x
            for a in amounts:
                left -= a if a <= left else 0
            assert x - shifts[np.searchsorted(breaks, x, "right") - 1] == left


@pytest.mark.parametrize("fold_rows", [1_000_000, 5])
def test_first_row_is_always_admitted_when_asked(spark, fold_rows):
    rows = [("k", i, START, False, a) for i, a in enumerate((500, 1, 0, 7))] + [("j", 10 + i, START, False, 1) for i in range(20)]
    out = context.admit(frame(spark, rows).withColumn("cap", F.lit(8)), ["key"], F.col("id"), "amount", "cap", first_always=True, fold_rows=fold_rows, block_rows=3)
    got = {r["id"]: r["admitted"] for r in out.collect()}
    assert [got[i] for i in range(4)] == [True, False, False, False] and sum(got[10 + i] for i in range(20)) == 8


@pytest.mark.parametrize("seed", [3, 4])
def test_failure_spans_equal_fold(spark, seed):
    rows = events(random.Random(seed))
    got = {r["id"]: r["state"] for r in limits.failure_spans(frame(spark, rows)).collect()}
    want = fold(rows, limits.breaker_start(), lambda s, t, f, a: limits.breaker_step(s, t, f, 3, 30))
    assert got == want and {"OPEN", "TRIPPED", "CLOSED"} <= set(want.values())


def test_running_values_equal_plain_windows(spark):
    rows = events(random.Random(6))
    df = frame(spark, rows)
    for how, plain in (("sum", F.sum), ("max", F.max)):
        got = usage.running(df, ["key"], F.col("amount"), "r", how=how, position=micros("ts"), tie="id", block_size=100_000_000).select("id", "r")
        from pyspark.sql import Window

        w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
        want = df.select("id", plain("amount").over(w).alias("r"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def stream_over(spark, tmp_path, rows, batches=3):
    """The rows as files, one micro-batch each, in time order."""
    ordered = sorted(rows, key=lambda r: (r[2], r[1]))
    size = -(-len(ordered) // batches)
    for i in range(batches):
        part = frame(spark, ordered[i * size:(i + 1) * size]).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    return pipeline.read_stream(spark, str(tmp_path / "in"), frame(spark, []).schema, files_per_trigger=1)


def test_streams_carry_state_over_micro_batches(spark, tmp_path):
    rows = events(random.Random(7), n=150)
    stream = stream_over(spark, tmp_path, rows)
    got = {r["id"]: r["accepted"] for r in pipeline.drain(keyed.limit_stream(stream, 5, 60), "t").collect()}
    assert got == fold(rows, (0, 0), lambda s, t, f, a: limits.limiter_step(s, t, 5, 60))
    spans = {r["id"]: r["state"] for r in pipeline.drain(keyed.failure_stream(stream), "t").collect()}
    assert spans == fold(rows, (0, 0), lambda s, t, f, a: limits.breaker_step(s, t, f, 3, 30))


def test_global_budget_equals_fold(spark, tmp_path):
    rows = events(random.Random(8), n=200)
    stream = stream_over(spark, tmp_path, rows).select(
        F.lit("global").alias("budget"), F.substring("key", 2, 9).cast("long").alias("user_id"), "id", "ts", F.col("amount").alias("reserved"))
    got = {r["id"]: r["verdict"] for r in pipeline.drain(state.global_budget_stream(
        stream, user_limit=500, minute_limit=120, minute_seconds=60, day_limit=900, day_seconds=86400), "t").collect()}
    users, minute, day, want = {}, (0, 0), (0, 0), {}
    for key, id_, ts, _, amount in sorted(rows, key=lambda r: (r[2], r[1])):
        who = (key, ts.date())
        if users.get(who, 0) + amount > 500:
            want[id_] = "USER_DAY"
            continue
        t = us(ts)
        ok, minute_next = limits.rolling_step(minute, t, amount, 120, 60)
        minute = minute_next
        if not ok:
            want[id_] = "GLOBAL_MINUTE"
            continue
        ok, day = limits.rolling_step(day, t, amount, 900, 86400)
        if not ok:
            minute = (minute[0], minute[1] - amount)
            want[id_] = "GLOBAL_DAY"
            continue
        users[who] = users.get(who, 0) + amount
        want[id_] = "ACCEPTED"
    assert got == want and len(set(want.values())) >= 3


@pytest.mark.parametrize("turns,tools,prompt,completion", [(4, 8, 100, 1000), (2, 1, 50, 60), (1, 0, 10, 10), (3, 2, 10**6, 10**6)])
def test_budgets_equal_fold(spark, turns, tools, prompt, completion):
    rng = random.Random(turns)
    rows = [("r%d" % rng.randrange(6), i, rng.choice(["MODEL", "MODEL_WITH_TOOLS", "TOOL"]), rng.randrange(0, 3000), rng.randrange(0, 40), rng.randrange(0, 40)) for i in range(300)]
    df = spark.createDataFrame(rows, "generation_id string, id long, kind string, elapsed_ms long, prompt_tokens long, completion_tokens long")
    got = {r["id"]: r["decision"] for r in guards.budget_decisions(df, turns=turns, tools=tools, prompt=prompt, completion=completion, seconds=2).collect()}
    used, want = {}, {}
    for run, id_, kind, elapsed, p, c in rows:
        n_turns, n_tools, sp, sc = used.get(run, (0, 0, 0, 0))
        if elapsed >= 2000:
            want[id_] = "TIME_BUDGET_EXHAUSTED"
        elif sp >= prompt or sc >= completion:
            want[id_] = "TOKEN_BUDGET_EXHAUSTED"
        elif kind == "TOOL":
            want[id_] = "ALLOWED" if n_tools < tools else "TOOL_BUDGET_EXHAUSTED"
            used[run] = (n_turns, n_tools + (n_tools < tools), sp, sc)
        else:
            ok = n_turns < (turns - 1 if kind == "MODEL_WITH_TOOLS" else turns)
            want[id_] = "ALLOWED" if ok else "ROUND_BUDGET_EXHAUSTED"
            if ok:
                used[run] = (n_turns + 1, n_tools, sp + p, sc + c)
    assert got == want


def test_third_equal_action_is_blocked(spark):
    rows = spark.createDataFrame([("g", i, "a") for i in range(4)] + [("g", 9, "b")], "generation_id string, id long, fingerprint string")
    got = {r["id"]: r["disposition"] for r in guards.repeated_actions(rows).collect()}
    assert got == {0: "ALLOW", 1: "WARN", 2: "BLOCK", 3: "BLOCK", 9: "ALLOW"}


def test_two_stagnant_rounds_stop(spark):
    rows = spark.createDataFrame([("g", i, s) for i, s in enumerate(["x", "x", " ", "x", "y", "y"])], "generation_id string, seq long, signature string")
    got = {r["seq"]: (r["stagnant_rounds"], r["stop"]) for r in guards.stagnation(rows).collect()}
    assert got == {0: (0, False), 1: (1, False), 3: (2, True), 4: (0, False), 5: (1, False)}


def messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, pos long, role string, content string, has_tool_calls boolean")


@pytest.mark.parametrize("fold_rows", [1_000_000, 1])
def test_compaction_skips_a_group_that_does_not_fit(spark, fold_rows):
    rows = [(1, 0, "system", "s", False), (1, 1, "user", "a" * 3, False), (1, 2, "user", "b" * 9, False), (1, 3, "user", "c" * 5, False)]
    kept = [r["pos"] for r in context.compact_messages(messages(spark, rows), 9, fold_rows=fold_rows).orderBy("pos").collect()]
    assert kept == [0, 1, 3]


def test_no_orphan_tool_message(spark):
    rows = [(1, 0, "user", "q" * 50, False), (1, 1, "assistant", "call", True), (1, 2, "tool", "t" * 30, False), (1, 3, "tool", "u" * 30, False), (1, 4, "user", "next", False)]
    for budget in range(4, 130, 7):
        kept = {r["pos"] for r in context.compact_messages(messages(spark, rows), budget).collect()}
        assert ({2, 3} & kept == set()) or {1, 2, 3} <= kept
        assert 4 in kept


def test_feedback_without_correction_is_only_proposed(spark):
    rows = [(1, 7, "bad", "too long", "q", None, START), (2, 7, "bad", "x", "q", "use tables", START), (3, 7, "good", None, "q", None, START)]
    df = spark.createDataFrame(rows, "feedback_id long, user_id long, rating string, reason string, source_query string, correction string, ts timestamp")
    got = {r["content"]: (r["memory_type"], r["status"], r["confidence"]) for r in memory.memories_from_feedback(df).collect()}
    assert got["too long"] == ("CORRECTION", "PROPOSED", 0.78) and got["use tables"] == ("CORRECTION", "ACTIVE", 0.95)
    assert got[memory.GOOD_DEFAULT] == ("PREFERENCE", "ACTIVE", 0.78)


def test_no_way_out_of_a_terminal_state(spark):
    rows = spark.createDataFrame([("g", 1, "RUNNING", 1), ("g", 2, "COMPLETED", 1), ("g", 3, "RUNNING", 1), ("h", 4, "RUNNING", 2)], "generation_id string, id long, status string, schema_version int")
    got = {r["id"]: (r["verdict"], r["state_version"]) for r in ledgers.transitions(rows).collect()}
    assert got == {1: ("OK", 1), 2: ("OK", 2), 3: ("AFTER_TERMINAL", 0), 4: ("BAD_SCHEMA", 0)}


def test_tool_ledger_replays_and_blocks(spark):
    calls = spark.createDataFrame(
        [(1, "g1", "a", "SUCCESS", "SAFE"), (2, "g1", "a", "REUSED", "SAFE"), (3, "g1", "w", "UNKNOWN", "AT_MOST_ONCE"), (4, "g1", "w", "UNKNOWN", "AT_MOST_ONCE"),
         (5, "g1", "f", "FAILED", "SAFE"), (6, "g1", "f", "SUCCESS", "SAFE"), (7, "g2", "a", "RUNNING", "SAFE"), (8, "g2", "p", "RUNNING", "REQUIRES_APPROVAL"), (9, "g2", "w", "RUNNING", "AT_MOST_ONCE")],
        "id long, generation_id string, fingerprint string, status string, replay_policy string")
    runs = spark.createDataFrame([("g1", None), ("g2", "g1")], "generation_id string, retry_of string")
    got = {r["id"]: r["disposition"] for r in limits.tool_ledger(calls, runs).collect()}
    assert got == {1: "EXECUTE", 2: "REUSE", 3: "EXECUTE", 4: "BLOCK", 5: "EXECUTE", 6: "EXECUTE", 7: "REUSE", 8: "BLOCK", 9: "BLOCK"}


def test_critical_alerts_come_first(spark):
    views = spark.createDataFrame([(1, "LLM", 85, 100, 15), (2, "LLM", 120, 100, 0), (3, "LLM", 10, 100, 90)], "user_id long, scope string, used long, limit_tokens long, remaining long")
    rows = usage.quota_alerts(views).orderBy(*usage.alert_order()).collect()
    assert [(r["user_id"], r["level"]) for r in rows] == [(2, "critical"), (1, "warning")]


def test_pending_question_expires(spark):
    day = dt.timedelta(hours=24)
    tasks = spark.createDataFrame([(1, 1, 5, START, START + day), (2, 1, 6, START, START + day), (3, 1, 7, START, START + day)],
                                  "user_id long, conversation_id long, task_id long, created_at timestamp, expires_at timestamp")
    answers = spark.createDataFrame([(1, 1, START + dt.timedelta(hours=1), "x"), (2, 1, START + dt.timedelta(hours=30), "x"), (3, 1, START, "  ")],
                                    "user_id long, conversation_id long, ts timestamp, answer string")
    assert {r["user_id"]: r["state"] for r in ledgers.pending_tasks(tasks, answers).collect()} == {1: "RESUMED", 2: "EXPIRED", 3: "WAITING"}


def json_tasks(rows, **more):
    fields = {"fileMd5": F.col("fileMd5"), "userId": F.lit("1"), **{k: v if not isinstance(v, str) else F.lit(v) for k, v in more.items()}}
    return pipeline.parse_tasks(rows.select(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("value")))


def test_ingestion_runs_again_without_loss(spark, tables):
    """A second batch keeps the first one's rows, and a completed file is not parsed twice."""
    base = pipeline.scratch_path(spark, "again")
    docs = tables.documents.select(F.md5("text").alias("fileMd5"), "text").dropDuplicates(["fileMd5"])
    some = docs.orderBy("fileMd5").limit(12).persist()
    first = json_tasks(some.orderBy("fileMd5").limit(8))
    pipeline.ingest_batch(first, some, base, 0)
    n = pipeline.index_of(spark, base).read().count()
    pipeline.ingest_batch(first, some, base, 0)
    assert pipeline.index_of(spark, base).read().count() == n
    pipeline.ingest_batch(json_tasks(some), some, base, 1)
    index = pipeline.index_of(spark, base).read()
    assert index.select("file_md5").distinct().count() == 12 and index.groupBy("file_md5", "user_id", "chunk_id").count().where("count > 1").count() == 0
    assert {r["batch"]: r["count"] for r in pipeline.statuses(spark, base).groupBy("batch").count().collect()} == {0: 8, 1: 4}
    # another owner of a known file has rows of their own; a new index embeds the stored passages, whatever the documents say
    pipeline.ingest_batch(json_tasks(some.limit(1), userId="2", orgTag="N1", isPublic=F.lit(True)), some, base, 2)
    one = some.first()["fileMd5"]
    assert pipeline.index_of(spark, base).read().where(F.col("file_md5") == one).select("user_id", "org_tag", "is_public").distinct().count() == 2

    def other(texts, key):
        return texts.select(*key, F.array(F.lit(0.5).cast("float")).alias("embedding"))

    pipeline.ingest_batch(json_tasks(some.limit(1), taskType="REINDEX"), some.where("false"), base, 3, other)
    index = pipeline.index_of(spark, base).read().where(F.col("file_md5") == one)
    assert {(r["user_id"], r["n"] == 1) for r in index.select("user_id", F.size("embedding").alias("n")).distinct().collect()} == {("1", True), ("2", False)}


def test_ingestion_reads_the_files_that_tasks_name(spark, tmp_path):
    (tmp_path / "a.txt").write_text("First paragraph of a.\n\nSecond one.")
    (tmp_path / "b.bin").write_bytes(b"<html><body><p>Page of b</p></body></html>")
    (tmp_path / "c.jsonl").write_text('{"text": "one"}\n{"text": "two"}\n')
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4")
    named = {"a": "a.txt", "b": "b.bin", "c": "c.jsonl", "d": "d.pdf", "gone": "missing.txt"}
    rows = spark.createDataFrame([(k, str(tmp_path / v)) for k, v in named.items()] + [("none", None)], "fileMd5 string, path string")
    base = pipeline.scratch_path(spark, "named")
    pipeline.ingest_batch(json_tasks(rows, filePath=F.col("path")), None, base, 0)
    got = {r["file_md5"]: (r["status"], r["reason"]) for r in pipeline.statuses(spark, base).collect()}
    assert got == {"a": ("COMPLETED", None), "b": ("COMPLETED", None), "c": ("COMPLETED", None), "d": ("FAILED", "pdf needs a parser"), "gone": ("FAILED", "FILE_NOT_FOUND"), "none": ("FAILED", "NO_FILE_PATH")}
    texts = {}
    for r in pipeline.index_of(spark, base).read().orderBy("file_md5", "chunk_id").collect():
        texts.setdefault(r["file_md5"], []).append(r["text"])
    assert " ".join(texts["a"]).split() == "First paragraph of a. Second one.".split() and texts["b"] == ["Page of b"] and " ".join(texts["c"]).split() == ["one", "two"]



def test_global_budget_slices_equal_fold():
    """Runs in a file, merged slice by slice, and requests answered together give the verdicts of one request at a time, at any share of rejections."""
    rng = random.Random(5)
    for limit, minute, day, top in ((500, 120, 900, 100), (50, 20, 100_000, 60), (90, 4_000, 5_000, 90), (10_000, 10**9, 10**9, 50), (60, 30, 45, 60)):
        rows = [(rng.randrange(0, 9) * 40_000_000_000 + rng.randrange(0, 30_000_000_000), i, rng.choice([1, 2, 3, 4, state.NOBODY]), rng.randrange(-1, top)) for i in range(6_000)]
        rows += [(rows[0][0], i, 1, 5) for i in range(6_000, 6_900)]  # more of one time than a run has
        rng.shuffle(rows)
        runs = state._Runs(512)
        for at in range(0, len(rows), 100):
            runs.add(np.array(rows[at : at + 100], np.int64).T)
        budget = state._Budget((0, 0, 0, 0, 0, [], []), limit, minute, 600, day, 86400)
        ids, got = [], []
        for us_, id_, user, amount in runs.slices():
            ids += id_.tolist()
            got += budget.fold(np.array(us_), user, amount).tolist()
        m, d, today, users, want = (0, 0), (0, 0), 0, {}, []
        for us_, _, user, amount in sorted(rows):
            if us_ // state.DAY != today:
                today, users = us_ // state.DAY, {}
            if users.get(user, 0) + amount > limit:
                want.append(state.USER_DAY)
                continue
            ok, m = limits.rolling_step(m, us_, amount, minute, 600)
            if not ok:
                want.append(state.GLOBAL_MINUTE)
                continue
            ok, d = limits.rolling_step(d, us_, amount, day, 86400)
            if ok:
                users[user] = users.get(user, 0) + amount
                want.append(state.ACCEPTED)
            else:
                m = (m[0], m[1] - amount)
                want.append(state.GLOBAL_DAY)
        assert ids == [r[1] for r in sorted(rows)] and got == want
        assert (budget.minute, budget.days, budget.day, budget.users) == (m, d, today, users)


def test_global_budget_keeps_requests_without_user_or_time(spark, tmp_path):
    """A request without a user, a time or an id is answered like any other; one without an amount asks for nothing and has no answer."""
    rows = [("g", 1, 1, dt.datetime(2024, 1, 1), 60), ("g", None, 2, dt.datetime(2024, 1, 1, 0, 1), 60), ("g", None, 3, dt.datetime(2024, 1, 1, 0, 2), 60), ("g", 1, 4, None, 30), ("g", 2, None, dt.datetime(2024, 1, 1, 0, 3), 5),
            ("g", 1, 5, dt.datetime(2024, 1, 1), None), ("g", 1, 2**62 + 1, dt.datetime(2024, 1, 1, 0, 4), 101), ("h", 1, 2**62 + 3, dt.datetime(2024, 1, 1, 0, 4), 100)]
    table = spark.createDataFrame(rows, "budget string, user_id long, id long, ts timestamp, reserved long")
    table.write.parquet(str(tmp_path / "in"))
    stream = pipeline.read_stream(spark, str(tmp_path / "in"), table.schema)
    out = pipeline.drain(state.global_budget_stream(stream, user_limit=100, minute_limit=1_000, minute_seconds=60, day_limit=10_000, day_seconds=86400), "t")
    assert sorted(((r["budget"], r["id"], r["verdict"]) for r in out.collect()), key=str) == sorted(
        [("g", 1, "ACCEPTED"), ("g", 2, "ACCEPTED"), ("g", 3, "USER_DAY"), ("g", 4, "ACCEPTED"), ("g", None, "ACCEPTED"), ("g", 2**62 + 1, "USER_DAY"), ("h", 2**62 + 3, "ACCEPTED")], key=str)


def test_ingestion_in_slices(spark, tmp_path, monkeypatch):
    """Files worked in slices leave the rows and states of one pass, and none of what was made on the way."""
    import os

    docs = spark.createDataFrame([(f"f{i}", " ".join(f"word{i}x{j}" for j in range(5 + i))) for i in range(8)], "fileMd5 string, text string").localCheckpoint()
    tasks = docs.select("fileMd5", F.lit(None).cast("string").alias("filePath"), F.lit("1").alias("userId"), F.lit("N1").alias("orgTag"), F.lit(False).alias("isPublic"), F.lit("").alias("taskType"), F.lit(True).alias("valid"))
    tasks = tasks.unionByName(tasks.limit(2).withColumn("userId", F.lit("2"))).unionByName(tasks.limit(1).withColumn("fileMd5", F.lit("lost")))
    found = []
    for size in (pipeline.SLICE_BYTES, 300):
        monkeypatch.setattr(pipeline, "SLICE_BYTES", size)
        base = str(tmp_path / str(size))
        pipeline.ingest_batch(tasks, docs, base, 0)
        pipeline.ingest_batch(tasks.where("fileMd5 IN ('f3', 'f4')").withColumn("taskType", F.lit("REINDEX")), docs.where("false"), base, 1)
        rows = pipeline.index_of(spark, base).read()
        found.append((sorted(map(str, rows.select(sorted(rows.columns)).collect())), sorted(map(str, pipeline.statuses(spark, base).collect()))))
    assert found[0] == found[1] and len(found[0][1]) == 11 and len(found[0][0]) >= 10
    kept = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir()).toUri().getPath()
    assert not [name for name in os.listdir(kept) if name.startswith("work-")]
