import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from indexward import schemas as S
from indexward.operators import gates
from indexward.sources import read_state, state_version, write_state
from indexward.streaming import lag_series, lag_throttle, lag_throttle_stream, state_from_changelog
from indexward.streaming import throttle_stream
from indexward.streaming.changelog import fold_changes

from conftest import rows

T0 = dt.datetime(2002, 1, 1)
LAYOUT = "instance_id long, ts timestamp, max_lag_bytes long"


def verdicts(series, limit, wait):
    """Plain loop over the samples of one instance: (ts, lag) in time order."""
    since, stopped, out = None, False, []
    for ts, lag in series:
        waited, warn = None, False
        if stopped:
            action = "stopped"
        elif lag is not None and lag > limit:
            since = since or ts
            waited = int((ts - since).total_seconds())
            stopped = waited >= wait
            action = "stop" if stopped else "pause"
            warn = not stopped and waited % 60 == 0
        else:
            since, action = None, "proceed"
        out.append((ts, lag, action, waited, warn))
    return out


def series(seed, n, step):
    rng = random.Random(seed)
    at, lag, out = T0, 0, []
    for _ in range(n):
        at += dt.timedelta(seconds=rng.choice([1, 5, step]), microseconds=rng.randrange(10**6))
        if rng.random() < 0.15:
            lag = rng.choice([0, 10, 11, 500])
        out.append((at, None if rng.random() < 0.03 else lag))
    return out


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([7, 60, 900]), st.sampled_from([30, 400, 10**6]))
def test_pauses_match_a_plain_loop_for_any_bucket(spark, seed, bucket_s, wait):
    data = {i: series(seed + i, 80, 90) for i in range(4)}
    df = spark.createDataFrame([(i, t, lag) for i, s in data.items() for t, lag in s], LAYOUT).repartition(3)
    got = lag_throttle(df, 10, wait, bucket_s)
    want = sorted(((i, *v) for i, s in data.items() for v in verdicts(s, 10, wait)), key=repr)
    assert rows(got) == want


def test_limits_are_strict_for_lag_and_inclusive_for_wait(spark):
    at = [T0 + dt.timedelta(seconds=s) for s in (0, 59, 60, 120, 180)]
    df = spark.createDataFrame([(1, t, lag) for t, lag in zip(at, (11, 11, 11, 11, 0))], LAYOUT)
    got = rows(lag_throttle(df, 10, 120), "action", "waited_s", "warn")
    assert sorted(got, key=repr) == sorted([("pause", 0, True), ("pause", 59, False), ("pause", 60, True), ("stop", 120, False), ("stopped", None, False)], key=repr)
    equal = spark.createDataFrame([(1, T0, 10)], LAYOUT)
    assert rows(lag_throttle(equal, 10), "action") == [("proceed",)]


def test_one_series_without_instances(spark):
    data = series(5, 60, 90)
    df = spark.createDataFrame([(t, lag) for t, lag in data], "ts timestamp, max_lag_bytes long")
    assert rows(lag_throttle(df, 10, 300, 60)) == sorted(verdicts(data, 10, 300), key=repr)


def samples(spark, n=200):
    """Two standbys per time and instance; one of them never reports a replay position."""
    data = []
    for i in (1, 2):
        for k, (t, lag) in enumerate(series(40 + i, n, 40)):
            replay = None if k % 17 == 0 else "0/0"
            data.append((i, "a", t, f"0/{(lag or 0):X}", replay, "sync"))
            data.append((i, "b", t, f"0/{(lag or 0) // 2:X}", None if k % 2 else replay, "async"))
    return spark.createDataFrame(data, S.REPLICATION)


def as_stream(spark, df, folder, files):
    """Files in time order, but with neighbours swapped: late samples inside the watermark."""
    from pyspark.sql import Window

    part = F.ntile(files).over(Window.orderBy("ts"))
    late = df.withColumn("_part", part + F.when((F.unix_micros("ts") % 5) == 0, 1).otherwise(0))
    for p in range(1, files + 2):
        late.filter(F.col("_part") == p).drop("_part").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(stream, folder, spark):
    query = (
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def test_the_stream_agrees_with_the_batch(spark, tmp_path):
    df = samples(spark)
    stream = as_stream(spark, df, f"{tmp_path}/in", 5)
    got = drain(lag_throttle_stream(stream, 10, 200, "12 minutes", poll=None), str(tmp_path), spark)
    batch = lag_throttle(gates.max_replica_lag(df), 10, 200)
    # A sample is judged once the watermark, in whole milliseconds, has passed it.
    last = int((df.agg(F.max("ts")).first()[0] - T0) / dt.timedelta(milliseconds=1))
    passed = F.floor(F.unix_micros("ts") / 1000) + 1 <= F.lit(last - 720_000) + F.unix_millis(F.lit(T0))
    want = batch.filter(passed)
    assert 100 < want.count() < batch.count()
    assert {r.action for r in want.collect()} == {"proceed", "pause", "stop", "stopped"}
    assert rows(got) == rows(want)


def test_polls_in_batch_and_stream(spark, tmp_path):
    df = samples(spark)
    batch = lag_series(df)
    assert batch.agg(F.sum("max_lag_bytes")).first()[0] > 0 and batch.filter("max_lag_bytes IS NULL").count() == 0
    stream = as_stream(spark, df, f"{tmp_path}/in", 5)
    got = drain(lag_series(stream, watermark="12 minutes"), str(tmp_path), spark)
    last = df.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=12, seconds=5)
    want = batch.filter(F.col("poll_start") <= F.lit(last))
    assert 50 < want.count() < batch.count()
    assert rows(got) == rows(want)


def state(spark, *names):
    return spark.createDataFrame([("s", "t", n, "btree", "pending", "x", T0, T0) for n in names], S.STATE_SCHEMA)


CHANGES = "schema_name string, index_name string, state string, session_id string, updated_at timestamp"


def test_changes_fold_once(spark, tmp_path):
    path = str(tmp_path / "state")
    write_state(state(spark, "a", "b"), path)
    at = [T0 + dt.timedelta(minutes=m) for m in (1, 2)]
    batch = spark.createDataFrame([("s", "a", "in_progress", "y", at[0]), ("s", "b", "completed", "y", at[1]), ("s", "b", "failed", None, at[0])], CHANGES)
    fold = fold_changes(path, lambda: T0, "updated_at")
    fold(batch, 0)
    fold(batch, 0)
    assert state_version(spark, path)[0] == 2
    assert rows(read_state(spark, path), "index_name", "state", "session_id", "updated_at") == [
        ("a", "in_progress", "y", at[0]), ("b", "completed", "x", at[1]),
    ]


def test_changes_as_a_stream(spark, tmp_path):
    path = str(tmp_path / "state")
    write_state(state(spark, "a", "b", "c"), path)
    for m, (name, new) in enumerate([("a", "in_progress"), ("a", "completed"), ("b", "failed"), ("zz", "failed")], 1):
        batch = spark.createDataFrame([("s", name, new, "y", T0 + dt.timedelta(minutes=m))], CHANGES)
        batch.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    changes = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    writer = state_from_changelog(changes, path, f"{tmp_path}/progress", lambda: T0)
    writer.trigger(availableNow=True).start().awaitTermination()
    assert rows(read_state(spark, path), "index_name", "state") == [("a", "completed"), ("b", "failed"), ("c", "pending")]
    assert state_version(spark, path)[0] == 5


def test_the_series_is_not_sorted_in_one_task(spark):
    df = spark.createDataFrame([(1, t, lag) for t, lag in series(3, 400, 30)], LAYOUT)
    got = lag_throttle(df, 10, 300)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text and "Python" not in text


def test_polled_stream_agrees_with_the_polled_batch(spark, tmp_path):
    df = samples(spark)
    stream = as_stream(spark, df, f"{tmp_path}/in", 5)
    got = drain(lag_throttle_stream(stream, 10, 200, "12 minutes", poll="20 seconds"), str(tmp_path), spark)
    end = F.col("poll_start") + F.expr("INTERVAL '19.999999' SECOND")
    batch = lag_throttle(lag_series(df, "20 seconds").withColumn("ts", end).drop("poll_start"), 10, 200)
    seen = got.agg(F.max("ts")).first()[0]
    want = batch.filter(F.col("ts") <= F.lit(seen))
    assert want.count() > 50 and rows(got) == rows(want)
    last = df.agg(F.max("ts")).first()[0]
    assert last - seen < dt.timedelta(minutes=12, seconds=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.sampled_from([0, 10, 11, 50])), min_size=1, max_size=30), st.sampled_from([1, 60, 300]), st.integers(1, 30))
def test_judged_in_pieces_as_in_a_plain_loop(steps, wait, cut):
    at, data = 0, []
    for step, lag in steps:
        at += step * 1_000_000
        data.append((at, lag))
    want = verdicts([(T0 + dt.timedelta(microseconds=t), lag) for t, lag in data], 10, wait)
    since, stopped, got = None, False, []
    for k in range(0, len(data), cut):
        part = np.array(data[k : k + cut], np.int64)
        frame, since, stopped = throttle_stream.judge(part[:, 0], part[:, 1], since, stopped, 10, wait)
        got += [(r.max_lag_bytes, r.action, None if pd.isna(r.waited_s) else int(r.waited_s), bool(r.warn)) for r in frame.itertuples()]
    assert got == [v[1:] for v in want]


class Held:
    """State of one key, in memory; counts the samples that are read."""

    def __init__(self):
        self.values, self.read = {}, 0

    def containsKey(self, key):
        return key in self.values

    def getValue(self, key):
        self.read += len(self.values[key][0]) // 16
        return self.values[key]

    def updateValue(self, key, value):
        self.values[key] = value

    def removeKey(self, key):
        del self.values[key]

    def keys(self):
        return iter(list(self.values))

    def exists(self):
        return "v" in self.values

    def get(self):
        return self.values["v"]

    def update(self, value):
        self.values["v"] = value

    def clear(self):
        self.values.clear()


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Held())

    getValueState = getMapState

    def registerTimer(self, at):
        self.timers.add(at)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def replay(n, idle_ms=None):
    """A backlog of n samples, one each five seconds, judged by all its timers; rows, samples read, handle."""
    handle, processor = Handle(), throttle_stream._Throttle(10, 10**9, idle_ms)
    processor.init(handle)
    times = [T0 + dt.timedelta(seconds=5 * i) for i in range(n)]
    list(processor.handleInputRows((1,), iter([pd.DataFrame({"ts": times, "lag_bytes": [i % 20 for i in range(n)]})]), None))
    handle.states["waiting"].read = 0
    out, end = 0, max(handle.timers) + 10**6
    while due := sorted(t for t in handle.timers if t <= end):
        handle.timers.discard(due[0])
        out += sum(len(f) for f in processor.handleExpiredTimer((1,), At(end), At(due[0])))
    return out, handle.states["waiting"].read, handle


def test_a_backlog_is_read_once(monkeypatch):
    for n in (100, 1000, 10_000):
        out, read, handle = replay(n)
        assert out == read == n and not handle.states["waiting"].values


def test_idle_instances_are_forgotten():
    assert replay(50, 60_000)[2].states["pause"].exists() is False
    assert replay(50)[2].states["pause"].exists()
    assert replay(50, 10**7)[2].states["pause"].exists()
