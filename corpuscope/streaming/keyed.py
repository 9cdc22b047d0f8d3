"""Keyed state with timers: limiters, reservations, failure spells, quiet runs and pending tasks as stateful processors.

State lives in the RocksDB store and is a few numbers per key; where keys are many and short-lived (runs, users of a day) they share the states of a fixed number of buckets. Every processor works in event time: a timer at the horizon of a state (the end of its
window, of its day, of its cool-down) clears it when the watermark passes, so a key that falls silent leaves nothing behind; rows that are later than the
watermark are dropped by Spark before they reach the state. Some rows are caused by time alone: a run without a step, a task without an answer.

Rows of one key and micro-batch come in frames of any number. Only the numbers that a rule needs are taken from them, as arrays; they are put in time order and
worked in slices, so no frame of all rows is ever built. The source bounds a micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpuscope.functions.times import micros
from corpuscope.operators import limits
from corpuscope.session import ship_package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLICE = 10_000
#: states that short-lived keys share: a call and a few messages for each bucket and micro-batch, instead of for each key
BUCKETS = 512
WATERMARK = "10 minutes"
DAY_MS = 86_400_000


def use_rocksdb(spark: SparkSession) -> None:
    """The store that this kind of state needs; queries started before keep theirs."""
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _timed(stream: DataFrame, watermark: str) -> DataFrame:
    """The stream in event time ``ts``; a watermark needs a time with zone."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def in_order(frames: Iterator[pd.DataFrame], columns: list[str]) -> list[np.ndarray]:
    """The ``columns`` of all frames as arrays, in the order of the first two."""
    parts = [[f[c].to_numpy() for c in columns] for f in frames]
    whole = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.lexsort((whole[1], whole[0]))
    return [c[order] for c in whole]


class Fold(StatefulProcessor):
    """Runs ``advance(state, arrays) -> (labels, state)`` over the time-ordered rows of a key; ``horizon(state)`` is when it may be forgotten (None: only when it is the start again)."""

    def __init__(self, keys: list[str], columns: list[str], kind: str, start: tuple, advance: Callable, horizon: Callable[[tuple], int | None], label: str):
        self.keys, self.columns, self.kind, self.start, self.advance, self.horizon, self.label = keys, columns, kind, start, advance, horizon, label

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", self.kind)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.current.get()) if self.current.exists() else self.start
        arrays = in_order(rows, self.columns)
        for at in range(0, len(arrays[0]), SLICE):
            some = [a[at : at + SLICE] for a in arrays]
            labels, state = self.advance(state, some)
            yield pd.DataFrame({**{k: [v] * len(some[1]) for k, v in zip(self.keys, key, strict=True)}, "id": some[1], self.label: labels})
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        state = tuple(int(v) for v in state)
        if state == self.start:
            self.current.clear()
            return
        self.current.update(state)
        until = self.horizon(state)
        if until is not None:
            self.handle.registerTimer(int(until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.current.exists():
            until = self.horizon(tuple(self.current.get()))
            if until is not None and until <= expiredTimerInfo.getExpiryTimeInMs():
                self.current.clear()
        return iter([])

    def close(self) -> None:
        pass


def _folded(stream: DataFrame, watermark: str, keys: list[str], columns: list[str], kind: str, start: tuple, advance: Callable, horizon: Callable, output: str) -> DataFrame:
    use_rocksdb(stream.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    slim = _timed(stream, watermark).select(*keys, "id", "ts", micros("ts").alias("us"), *columns)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", id {kinds['id']}, {output}"
    fold = Fold(keys, ["us", "id", *columns], kind, start, advance, horizon, output.split()[0])
    return slim.groupBy(*keys).transformWithStateInPandas(fold, schema, "Append", "EventTime")


def limit_block(state: tuple[int, int], us: np.ndarray, maximum: int, seconds: int) -> tuple[np.ndarray, tuple[int, int]]:
    """``limits.limiter_step`` over sorted times, a window at a time. State: window start and events counted in it."""
    start, count = state
    now, width = us // 1000 * 1000, seconds * 1_000_000
    accepted, at = np.zeros(len(us), bool), 0
    while at < len(us):
        if count == 0 or now[at] >= start + width:
            start, count = int(now[at]), 0
        end = max(at + 1, int(np.searchsorted(now, start + width)))
        accepted[at : at + max(0, min(end - at, maximum - count))] = True
        count, at = count + end - at, end
    return accepted, (start, count)


def limit_stream(events: DataFrame, maximum: int, seconds: int, watermark: str = WATERMARK) -> DataFrame:
    """First-event-anchored fixed window limiter on (key, id, ts): (key, id, accepted). A window is forgotten at its end."""
    return _folded(events, watermark, ["key"], [], "start bigint, n bigint", (0, 0), lambda s, a: limit_block(s, a[0], maximum, seconds),
                   lambda s: s[0] // 1000 + seconds * 1000, "accepted boolean")


def dual_limit_stream(events: DataFrame, minute_max: int, minute_seconds: int, day_max: int, day_seconds: int, watermark: str = WATERMARK) -> DataFrame:
    """Minute limit, then the day limit that only accepted events charge: (key, id, verdict). Both windows are forgotten at the later end."""

    def advance(state, arrays):
        minute, short = limit_block(state[:2], arrays[0], minute_max, minute_seconds)
        day, long = limit_block(state[2:], arrays[0][minute], day_max, day_seconds)
        verdicts = np.full(len(minute), "MINUTE_LIMIT", dtype=object)
        verdicts[minute] = np.where(day, "ACCEPTED", "DAY_LIMIT")
        return verdicts, (*short, *long)

    def horizon(state):
        return max(state[0] // 1000 + minute_seconds * 1000, state[2] // 1000 + day_seconds * 1000 if state[3] else 0)

    return _folded(events, watermark, ["key"], [], "m0 bigint, m1 bigint, d0 bigint, d1 bigint", (0, 0, 0, 0), advance, horizon, "verdict string")


def failure_stream(calls: DataFrame, threshold: int = limits.FAILURE_THRESHOLD, cooldown: int = limits.COOLDOWN_SECONDS, watermark: str = WATERMARK) -> DataFrame:
    """Consecutive-failure detector on (key, id, ts, failed): (key, id, state). An open span is forgotten after its cool-down, a count of failures at the next success."""

    def advance(state, arrays):
        labels = []
        for us, failed in zip(arrays[0].tolist(), arrays[2].tolist(), strict=True):
            label, state = limits.breaker_step(state, us, failed, threshold, cooldown)
            labels.append(label)
        return labels, state

    return _folded(calls, watermark, ["key"], ["failed"], "failures bigint, opened bigint", limits.breaker_start(), advance,
                   lambda s: s[1] // 1000 + cooldown * 1000 + 1 if s[1] else None, "state string")


def bucket_of(name: str, buckets: int) -> Column:
    """The bucket of a key, where many keys share one state and one call."""
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int").alias("bucket")


class Reserve(StatefulProcessor):
    """Daily totals of the users of a bucket in a map from the day to what they reserved; a day is removed when it is over."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getMapState("totals", "day bigint", "users array<string>, reserved array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        us, ids, users, amounts = in_order(rows, ["us", "id", "user", "reserved"])
        if us.dtype.kind == "f" or amounts.dtype.kind == "f":
            raise ValueError("a reservation without a time or an amount")
        codes, names = pd.factorize(users, use_na_sentinel=False)
        names = [None if pd.isna(n) else n for n in names.tolist()]
        days = us // (DAY_MS * 1000)
        order = np.lexsort((codes, days))  # of one user and day in time order
        us, ids, amounts, codes, days = (a[order] for a in (us, ids, amounts, codes, days))
        begins = np.flatnonzero(np.concatenate([[True], (np.diff(days) != 0) | (np.diff(codes) != 0)]))
        ends = np.append(begins[1:], len(days))
        held, known = {}, set()
        for day in np.unique(days).tolist():
            held[day] = {}
            if self.totals.containsKey((day,)):
                known.add(day)
                held[day] = dict(zip(*self.totals.getValue((day,)), strict=True))
        groups = [(day, names[code]) for day, code in zip(days[begins].tolist(), codes[begins].tolist(), strict=True)]
        before = np.array([held[day].get(user, 0) for day, user in groups], np.int64)
        after = before + np.add.reduceat(amounts, begins)
        fits = (after <= self.limit) & (np.minimum.reduceat(amounts, begins) >= 0)  # all of the group
        admitted = np.ones(len(days), bool)
        for at in np.flatnonzero(~fits).tolist():
            total = int(before[at])
            for place, amount in enumerate(amounts[begins[at] : ends[at]].tolist(), int(begins[at])):
                admitted[place], total = limits.reserve_step(total, amount, self.limit)
            after[at] = total
        for (day, user), total in zip(groups, after.tolist(), strict=True):
            held[day][user] = total
        for day, totals in held.items():
            self.totals.updateValue((day,), (list(totals), list(totals.values())))
            if day not in known:
                self.handle.registerTimer((day + 1) * DAY_MS)
        named = np.array([*names, None], object)  # objects, whatever the names are
        for at in range(0, len(days), SLICE):
            some = slice(at, at + SLICE)
            yield pd.DataFrame({"user": named[codes[some]], "day": pd.to_datetime(days[some], unit="D").date, "id": ids[some], "admitted": admitted[some]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.totals.removeKey((expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 1,))
        return iter([])

    def close(self) -> None:
        pass


def reserve_stream(requests: DataFrame, daily_limit: int, watermark: str = WATERMARK, buckets: int = BUCKETS) -> DataFrame:
    """Daily reservation with rollback on (user_id, id, ts, reserved): (user_id, day, id, admitted). Users share ``buckets`` states."""
    use_rocksdb(requests.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    slim = _timed(requests, watermark).select(bucket_of("user_id", buckets), F.col("user_id").cast("string").alias("user"), "id", "ts", micros("ts").alias("us"), "reserved")
    done = slim.groupBy("bucket").transformWithStateInPandas(Reserve(daily_limit), f"user string, day date, id {kinds['id']}, admitted boolean", "Append", "EventTime")
    return done.select(F.col("user").cast(kinds["user_id"]).alias("user_id"), "day", "id", "admitted")


class Quiet(StatefulProcessor):
    """Emits a run that is still running when no step came for a while; its last step stays in the state until then.

    The runs of a bucket stand in a list of parts of up to ``SLICE`` runs, with one timer at the time when the first of them is quiet.
    """

    def __init__(self, quiet_ms: int, running: tuple[str, ...]):
        self.quiet_ms, self.running = quiet_ms, running

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "runs array<string>, us array<bigint>, ids array<bigint>, statuses array<string>")

    def _held(self) -> dict:
        """Run to (time, id, status) of its last step."""
        if not self.last.exists():
            return {}
        return {run: last for runs, *steps in self.last.get() for run, last in zip(runs, zip(*steps, strict=True), strict=True)}

    def _hold(self, held: dict) -> None:
        if not held:
            self.last.clear()
            return
        rows = list(held.items())
        parts = [rows[at : at + SLICE] for at in range(0, len(rows), SLICE)]
        self.last.put([([run for run, _ in part], *([step[k] for _, step in part] for k in range(3))) for part in parts])
        self.handle.registerTimer(self._due(min(us for us, _, _ in held.values())))

    def _due(self, us: int) -> int:
        return us // 1000 + self.quiet_ms + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        us, ids, runs, status = in_order(rows, ["us", "id", "generation_id", "status"])
        if us.dtype.kind == "f":
            raise ValueError("a step without a time")
        codes, names = pd.factorize(runs, use_na_sentinel=False)
        latest = np.full(len(names), np.iinfo(np.int64).min)
        np.maximum.at(latest, codes, us)
        # of each run the step of largest id, the earliest of several
        order = np.lexsort((-np.arange(len(ids)), ids, codes))
        newest = order[np.append(np.flatnonzero(np.diff(codes[order])), len(order) - 1)]
        held = self._held()
        for name, late, top, last in zip(names.tolist(), latest.tolist(), ids[newest].tolist(), status[newest].tolist(), strict=True):
            run, top, last = None if pd.isna(name) else name, int(top), str(last)
            if run in held:
                old_us, old_id, old_status = held[run]
                late, (top, last) = max(late, old_us), max((top, last), (old_id, old_status))
            held[run] = (late, top, last)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self._hold(held)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        held = self._held()
        over = {run: step for run, step in held.items() if self._due(step[0]) <= until}
        self._hold({run: step for run, step in held.items() if run not in over})
        found = [(run, us) for run, (us, _, status) in over.items() if status in self.running]
        for at in range(0, len(found), SLICE):
            runs, us = zip(*found[at : at + SLICE], strict=True)
            # their event time is when they were found quiet, so that what follows in the query goes on in event time
            yield pd.DataFrame({"generation_id": runs, "last_us": us, "new_status": "INTERRUPTED", "found_at": pd.to_datetime([self._due(u) for u in us], unit="ms")})

    def close(self) -> None:
        pass


def interrupted_stream(steps: DataFrame, minutes: int, running: tuple[str, ...] = ("RUNNING",), watermark: str = WATERMARK, buckets: int = BUCKETS) -> DataFrame:
    """(generation_id, last_us, new_status, found_at) of runs whose newest step leaves them running and that were quiet for ``minutes``, once per quiet time.

    ``steps``: generation_id, id, ts, status. No input row is needed for a run to come out: the watermark passes its timer. Runs share ``buckets`` states.
    """
    use_rocksdb(steps.sparkSession)
    slim = _timed(steps, watermark).select(bucket_of("generation_id", buckets), "generation_id", "id", "ts", micros("ts").alias("us"), "status")
    return slim.groupBy("bucket").transformWithStateInPandas(
        Quiet(minutes * 60_000, running), "generation_id string, last_us bigint, new_status string, found_at timestamp", "Append", "EventTime", eventTimeColumnName="found_at")


class Pending(StatefulProcessor):
    """The waiting task of one user: an answer in time resumes it, a newer task takes its place, and time alone expires it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "task_id bigint, expires_us bigint")

    def _row(self, key, task_id: int, state: str, us: int) -> dict:
        return {"user_id": key[0], "task_id": task_id, "state": state, "at_us": us}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        us, ids, kinds, expires = in_order(rows, ["us", "id", "is_task", "expires_us"])
        task = tuple(self.task.get()) if self.task.exists() else None
        out = []
        for at, number, is_task, until in zip(us.tolist(), ids.tolist(), kinds.tolist(), expires.tolist(), strict=True):
            if task and task[1] < at:
                out.append(self._row(key, task[0], "EXPIRED", task[1]))
                task = None
            if is_task:
                if task:
                    out.append(self._row(key, task[0], "REPLACED", at))
                task = (number, until)
            elif task:
                out.append(self._row(key, task[0], "RESUMED", at))
                task = None
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if task:
            self.task.update(task)
            self.handle.registerTimer(task[1] // 1000 + 1)
        else:
            self.task.clear()
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.task.exists():
            task_id, until = self.task.get()
            if until // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
                self.task.clear()
                yield pd.DataFrame([self._row(key, task_id, "EXPIRED", until)])

    def close(self) -> None:
        pass


def pending_stream(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """(user_id, task_id, state, at_us) when a task is RESUMED, REPLACED or EXPIRED; a task that still waits gives no row.

    ``events``: user_id, id, ts, is_task, expires_us (of tasks); the others are answers.
    """
    use_rocksdb(events.sparkSession)
    slim = _timed(events, watermark).select("user_id", "id", "ts", micros("ts").alias("us"), "is_task", F.coalesce("expires_us", F.lit(0)).alias("expires_us"))
    return slim.groupBy("user_id").transformWithStateInPandas(Pending(), "user_id bigint, task_id bigint, state string, at_us bigint", "Append", "EventTime")


def settlement_stream(reservations: DataFrame, outcomes: DataFrame, within: str, watermark: str = WATERMARK) -> DataFrame:
    """Each reservation with its outcome, or an abort for one that was not settled ``within`` its time: (id, quota_key, reserved, outcome, final).

    ``reservations``: id, quota_key, ts, reserved. ``outcomes``: id, ts, outcome (settle or abort), actual. A stream-stream outer join with a bound on both sides, so
    that the state of either is dropped; an outcome before its reservation, or after its time, has no effect.
    """
    held = _timed(reservations, watermark).select(F.col("id").alias("r_id"), "quota_key", F.col("ts").alias("r_ts"), "reserved")
    said = _timed(outcomes, watermark).select(F.col("id").alias("o_id"), F.col("ts").alias("o_ts"), "outcome", "actual")
    met = held.join(said, F.expr(f"r_id = o_id AND o_ts >= r_ts AND o_ts <= r_ts + INTERVAL {within}"), "leftOuter")
    final = F.when(F.col("outcome") == "settle", F.col("actual")).otherwise(F.lit(0)).cast("long")
    return met.select(F.col("r_id").alias("id"), "quota_key", "reserved", F.coalesce("outcome", F.lit("abort")).alias("outcome"), F.col("o_id").isNull().alias("timed_out"), final.alias("final"))
