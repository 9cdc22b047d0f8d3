"""Streams with state, timers and retries: against one-event-at-a-time folds, over micro-batches and restarts."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuscope.operators import limits
from corpuscope.streaming import keyed, pipeline, retries
from test_state import START, events, fold, frame, stream_over


def ids(df, value):
    return {r["id"]: r[value] for r in df.collect()}


def reserved_of(stream):
    return stream.select(F.hash("key").cast("long").alias("user_id"), "id", "ts", F.col("amount").alias("reserved"))


def test_dual_limits_failures_and_reserves_over_micro_batches(spark, tmp_path):
    rows = events(random.Random(8), n=160)
    stream = lambda: pipeline.read_stream(spark, str(tmp_path / "in"), frame(spark, []).schema, files_per_trigger=1)
    stream_over(spark, tmp_path, rows)

    def dual(s, t, f, a):
        ok, m = limits.limiter_step(s[0], t, 3, 60)
        if not ok:
            return "MINUTE_LIMIT", (m, s[1])
        ok, d = limits.limiter_step(s[1], t, 10, 3600)
        return ("ACCEPTED" if ok else "DAY_LIMIT"), (m, d)

    assert ids(pipeline.drain(keyed.dual_limit_stream(stream(), 3, 60, 10, 3600), "d"), "verdict") == fold(rows, ((0, 0), (0, 0)), dual)
    assert ids(pipeline.drain(keyed.failure_stream(stream()), "f"), "state") == fold(rows, limits.breaker_start(), lambda s, t, f, a: limits.breaker_step(s, t, f, 3, 30))
    daily = [(f"{k}/{ts.date()}", i, ts, f, a) for k, i, ts, f, a in rows]
    assert ids(pipeline.drain(keyed.reserve_stream(reserved_of(stream()), 300), "r"), "admitted") == fold(daily, 0, lambda s, t, f, a: limits.reserve_step(s, a, 300))


def run_to(stream, base):
    stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out").awaitTermination()


def held(spark, base, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{base}/state")


def test_state_is_gone_after_its_horizon(spark, tmp_path):
    at = lambda day, s=0: START + dt.timedelta(days=day, seconds=s)
    # each micro-batch is one file; the watermark of a batch is the newest event of the one before
    batches = [[("a", 1, at(0), False, 1), ("b", 2, at(0, 5), True, 1)], [("c", 3, at(0, 3_000), False, 1)], [("d", 4, at(2), False, 1)], [("e", 5, at(2, 30), False, 1)]]
    for i, batch in enumerate(batches):
        frame(spark, batch).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: pipeline.read_stream(spark, str(tmp_path / "in"), frame(spark, []).schema, files_per_trigger=1)
    run_to(keyed.limit_stream(stream(), 5, 60, watermark="1 second"), tmp_path / "limit")
    assert {r["key"]["key"] for r in held(spark, tmp_path / "limit", "current").collect()} == {"d", "e"}
    run_to(keyed.reserve_stream(reserved_of(stream()), 300, watermark="1 second"), tmp_path / "reserve")
    assert held(spark, tmp_path / "reserve", "totals").count() == 2
    # a count of failures is kept until a success, without an end; keys without one leave nothing
    run_to(keyed.failure_stream(stream(), watermark="1 second"), tmp_path / "failures")
    assert {r["key"]["key"] for r in held(spark, tmp_path / "failures", "current").collect()} == {"b"}


def test_a_large_key_is_worked_in_slices(monkeypatch):
    """Frames of one key are never put together to one; rows go out in slices, in time order."""
    monkeypatch.setattr(pd, "concat", lambda *a, **k: pytest.fail("frames were put together"))
    monkeypatch.setattr(keyed, "SLICE", 1_000)

    class Handle:
        stored, timers = None, []

        def getValueState(self, *_):
            return self

        def exists(self):
            return self.stored is not None

        def get(self):
            return self.stored

        def update(self, value):
            self.stored = value

        def listTimers(self):
            return iter(())

        def registerTimer(self, at):
            self.timers.append(at)

    handle = Handle()
    folded = keyed.Fold(["key"], ["us", "id"], "start bigint, n bigint", (0, 0), lambda s, a: keyed.limit_block(s, a[0], 3, 60), lambda s: s[0] // 1000 + 60_000, "accepted")
    folded.init(handle)
    order = random.Random(1).sample(range(25_000), 25_000)
    frames = (pd.DataFrame({"us": [i * 1_000_000 for i in order[j : j + 500]], "id": order[j : j + 500]}) for j in range(0, 25_000, 500))
    out = list(folded.handleInputRows(("k",), frames, None))
    assert len(out) == 25 and all(len(f) == 1_000 for f in out)
    assert [i for f in out for i in f["id"]] == list(range(25_000)) and sum(f["accepted"].sum() for f in out) == 3 * -(-25_000 // 60)
    assert handle.stored == (24_960_000_000, 40) and handle.timers == [24_960_000 + 60_000]


def test_time_alone_brings_rows_about(spark, tmp_path):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    schema = "generation_id string, id long, ts timestamp, status string"
    batches = [[("a", 1, at(0), "view"), ("b", 2, at(1), "view"), ("c", 3, at(2), "done")], [("b", 4, at(100), "view")], [("z", 5, at(200), "done")], [("z", 6, at(260), "done")]]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = pipeline.read_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    found = pipeline.drain(keyed.interrupted_stream(stream, 120, ("view",), watermark="1 second"), "q")
    # b went on at 100 and fell silent then, c had ended, z is not quiet yet
    assert {(r["generation_id"], r["last_us"]) for r in found.collect()} == {("a", int(at(0).replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)), ("b", int(at(100).replace(tzinfo=dt.timezone.utc).timestamp() * 1e6))}


def test_many_runs_share_states(spark, tmp_path):
    """Thousands of runs over micro-batches: found quiet as by hand, with as many states as buckets."""
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    schema = "generation_id string, id long, ts timestamp, status string"
    steps = [(f"g{i % 900}" if i % 97 else None, i, at(i % 50 + 100 * batch), "view" if i % 3 else "done") for batch in range(2) for i in range(2_000 * batch, 2_000 * batch + 900 + 600 * (1 - batch))]
    for rows in ([r for r in steps if r[1] < 2_000], [r for r in steps if r[1] >= 2_000], [("z", 9_000, at(262), "done")], [("z", 9_001, at(264), "done")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = pipeline.read_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    run_to(keyed.interrupted_stream(stream, 120, ("view",), watermark="1 second", buckets=8), tmp_path / "quiet")
    moment = lambda ts: int((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    newest, latest = {}, {}
    for run, id_, ts, status in steps:
        newest[run], latest[run] = status, max(latest.get(run, 0), moment(ts))
    want = {(run, us) for run, us in latest.items() if newest[run] == "view" and us // 1000 + 7_200_001 <= moment(at(264)) // 1000 - 1_000}
    got = [(r["generation_id"], r["last_us"], r["found_at"]) for r in spark.read.parquet(str(tmp_path / "quiet" / "out")).collect()]
    assert len(got) == len(want) and {g[:2] for g in got} == want and 0 < len(want) < len(latest)
    assert all(moment(found) // 1000 == us // 1000 + 7_200_001 for _, us, found in got)
    assert held(spark, tmp_path / "quiet", "last").select("key").distinct().count() <= 8


def test_many_users_share_daily_totals(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(400)}", i, START + dt.timedelta(minutes=2 * i), False, rng.randint(-5, 150)) for i in range(2_400)]
    rows = [(None if k == "k7" else k, *r) for k, *r in rows]
    for some in (rows[:900], rows[900:1_500], rows[1_500:]):
        frame(spark, some).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = pipeline.read_stream(spark, str(tmp_path / "in"), frame(spark, []).schema, files_per_trigger=1)
    run_to(keyed.reserve_stream(stream.select(F.col("key").alias("user_id"), "id", "ts", F.col("amount").alias("reserved")), 200, buckets=8), tmp_path / "reserve")
    got = spark.read.parquet(str(tmp_path / "reserve" / "out")).collect()
    daily = [((k, ts.date()), i, ts, f, a) for k, i, ts, f, a in rows]
    assert {r["id"]: r["admitted"] for r in got} == fold(daily, 0, lambda s, t, f, a: limits.reserve_step(s, a, 200))
    assert sorted((r["id"], r["user_id"], r["day"]) for r in got) == [(i, k, ts.date()) for k, i, ts, _, _ in rows]
    assert held(spark, tmp_path / "reserve", "totals").select("key").distinct().count() <= 8


def test_pending_tasks(spark, tmp_path):
    at = lambda hours: START + dt.timedelta(hours=hours)
    rows = [(1, 1, at(0), True), (1, 2, at(3), False), (2, 3, at(0), True), (2, 4, at(30), False), (3, 5, at(0), True), (3, 6, at(4), True), (3, 7, at(5), False), (4, 8, at(1), True), (5, 9, at(40), True), (6, 10, at(2), False)]
    frame_ = spark.createDataFrame([(u, i, t, k, t + dt.timedelta(hours=24) if k else None) for u, i, t, k in rows], "user_id long, id long, ts timestamp, is_task boolean, until timestamp")
    frame_.withColumn("expires_us", F.unix_micros("until")).drop("until").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = pipeline.read_stream(spark, str(tmp_path / "in"), "user_id long, id long, ts timestamp, is_task boolean, expires_us long")
    got = {(r["user_id"], r["task_id"]): r["state"] for r in pipeline.drain(keyed.pending_stream(stream, "1 second"), "p").collect()}
    assert got == {(1, 1): "RESUMED", (2, 3): "EXPIRED", (3, 5): "REPLACED", (3, 6): "RESUMED", (4, 8): "EXPIRED"}


def test_settlements(spark, tmp_path):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    spark.createDataFrame([(1, "q", at(0), 10), (2, "q", at(1), 20), (3, "q", at(2), 30), (4, "q", at(3), 40), (5, "q", at(90), 50)], "id long, quota_key string, ts timestamp, reserved long").coalesce(1).write.parquet(str(tmp_path / "r"))
    spark.createDataFrame([(1, at(5), "settle", 8), (2, at(6), "abort", 0), (3, at(50), "settle", 25), (9, at(90), "settle", 1)], "id long, ts timestamp, outcome string, actual long").coalesce(1).write.parquet(str(tmp_path / "o"))
    held_ = pipeline.read_stream(spark, str(tmp_path / "r"), "id long, quota_key string, ts timestamp, reserved long")
    said = pipeline.read_stream(spark, str(tmp_path / "o"), "id long, ts timestamp, outcome string, actual long")
    got = {r["id"]: (r["outcome"], r["timed_out"], r["final"]) for r in pipeline.drain(keyed.settlement_stream(held_, said, "30 MINUTES", "1 second"), "s").collect()}
    # 3 was settled too late and 4 never; 5 may still be settled
    assert got == {1: ("settle", False, 8), 2: ("abort", False, 0), 3: ("abort", True, 0), 4: ("abort", True, 0)}


@pytest.mark.parametrize("stop_at", ["done", "dead", "failed"])
def test_a_restart_doubles_and_loses_nothing(spark, tmp_path, monkeypatch, stop_at):
    tasks = spark.range(60).withColumn("need", (F.col("id") % 7).cast("int") + 1)
    tasks.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: pipeline.read_stream(spark, str(tmp_path / "in"), tasks.schema)
    work = lambda rows: rows.withColumn("ok", F.col("attempt") >= F.col("need"))
    base = str(tmp_path / "base")
    stopped, real = [], type(tasks.write).parquet

    def parquet(self, path, *a, **k):
        if not stopped and path == f"{base}/{stop_at}/batch=0":
            stopped.append(path)
            raise RuntimeError("lost between two writes")
        return real(self, path, *a, **k)

    monkeypatch.setattr(type(tasks.write), "parquet", parquet)
    with pytest.raises(Exception, match="lost between two writes"):
        retries.retry_stream(stream(), work, base).awaitTermination()
    done, dead = retries.drain_with_retries(stream(), work, base)
    want = {i: i % 7 + 1 for i in range(60)}
    assert sorted((r["id"], r["attempt"]) for r in done.collect()) == sorted((i, n) for i, n in want.items() if n <= 5)
    assert sorted((r["id"], r["attempt"]) for r in dead.collect()) == sorted((i, 5) for i, n in want.items() if n > 5)
