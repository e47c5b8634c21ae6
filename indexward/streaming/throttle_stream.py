"""The lag throttle as a stateful stream.

Samples wait in state until the watermark has passed them and are then judged
in time order, so late samples do not change the verdicts. The state of an
instance is the open pause, the stop mark and the samples inside the watermark
delay, in a map by short buckets of time. Only buckets that are due are read,
so a backlog of any length costs each sample one read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schemas import DEFAULT_LAG_WAIT_S, LAG_WARN_EVERY_S
from .lag import POLL_INTERVAL, sample_lag

# The processor travels with the query, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SCHEMA = T.StructType([
    T.StructField("instance_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("max_lag_bytes", T.LongType()),
    T.StructField("action", T.StringType()),
    T.StructField("waited_s", T.LongType()),
    T.StructField("warn", T.BooleanType()),
])


# Stands for "no standby has replayed" while samples of one time are combined.
_NO_REPLAY = -(1 << 62)


#: Length of a bucket of waiting samples.
BUCKET_US = 60_000_000


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64")


def judge(ts: np.ndarray, lag: np.ndarray, since: int | None, stopped: bool, max_lag: int, wait_s: int) -> tuple[pd.DataFrame, int | None, bool]:
    """Verdicts of samples in time order after an open pause or a stop, and the pause and stop that they leave.

    Runs of samples above the limit are found for all samples at once: each has the start of its run, or of the open pause.
    """
    at = np.arange(len(ts))
    over = lag > max_lag
    before = np.concatenate([[since is not None], over[:-1]])
    begin = np.maximum.accumulate(np.where(over & ~before, at, -1))
    ended = np.maximum.accumulate(np.where(~over, at, -1))
    start = np.where(begin > ended, ts[begin], since if since is not None else 0)
    waited = (ts - start) // 1_000_000
    stops = over & (waited >= wait_s)
    first = -1 if stopped else int(stops.argmax()) if stops.any() else len(ts)
    action = np.select([at > first, at == first, over], ["stopped", "stop", "pause"], "proceed")
    paused = np.isin(action, ["pause", "stop"])
    verdicts = pd.DataFrame({
        "ts": pd.to_datetime(ts, unit="us"), "max_lag_bytes": np.where(lag == _NO_REPLAY, 0, lag), "action": action,
        "waited_s": pd.Series(waited).where(paused).astype("Int64"), "warn": (action == "pause") & (waited % LAG_WARN_EVERY_S == 0),
    })
    stopped = first < len(ts)
    since = int(start[min(first, len(ts) - 1)]) if stopped and first >= 0 else since if stopped else int(start[-1]) if over[-1] else None
    return verdicts, since, stopped


class _Throttle(StatefulProcessor):
    def __init__(self, max_lag: int, wait_s: int, idle_ms: int | None = None):
        self.max_lag = max_lag
        self.wait_s = wait_s
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Samples of a bucket as pairs of 64-bit integers, unordered.
        self.waiting = handle.getMapState("waiting", "bucket long", "samples binary")
        self.pause = handle.getValueState("pause", "since long, stopped boolean, seen long")

    def _samples(self, bucket: int) -> np.ndarray:
        held = self.waiting.getValue((bucket,)) if self.waiting.containsKey((bucket,)) else None
        return np.frombuffer(held[0] if held else b"", np.int64).reshape(-1, 2)

    def _wake_at(self, ts: int) -> None:
        self.handle.registerTimer(ts // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            worst = batch.groupby(_micros(batch["ts"]))["lag_bytes"].max()
            new = np.stack([worst.index.to_numpy(np.int64), worst.to_numpy(np.int64)], axis=1)
            for bucket in np.unique(new[:, 0] // BUCKET_US).tolist():
                mine, held = new[new[:, 0] // BUCKET_US == bucket], self._samples(bucket)
                self.waiting.updateValue((bucket,), (np.concatenate([held, mine]).tobytes(),))
                if not len(held) or mine[:, 0].min() < held[:, 0].min():
                    self._wake_at(int(mine[:, 0].min()))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The first timer of a batch serves all buckets that are due; those of the others are then gone.
        watermark, expired = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        if not self.waiting.containsKey(((expired - 1) * 1000 // BUCKET_US,)):
            self._forget(watermark)
            return
        parts = []
        for bucket in sorted(b for (b,) in self.waiting.keys() if b * BUCKET_US // 1000 < watermark):
            held = self._samples(bucket)
            passed = held[:, 0] // 1000 + 1 <= watermark
            parts.append(held[passed])
            early = held[~passed]
            if len(early) == len(held):
                continue
            if len(early):
                self.waiting.updateValue((bucket,), (early.tobytes(),))
                self._wake_at(int(early[:, 0].min()))
            else:
                self.waiting.removeKey((bucket,))
        due = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
        if not len(due):
            return
        # Of samples of one time the largest lag counts.
        due = due[np.lexsort((due[:, 1], due[:, 0]))]
        due = due[np.append(due[1:, 0] != due[:-1, 0], True)]
        since, stopped, _ = self.pause.get() if self.pause.exists() else (None, False, None)
        frame, since, stopped = judge(due[:, 0], due[:, 1], since, stopped, self.max_lag, self.wait_s)
        last = int(due[-1, 0])
        self.pause.update((since, stopped, last))
        if self.idle_ms is not None:
            self.handle.registerTimer(last // 1000 + 1 + self.idle_ms)
        frame.insert(0, "instance_id", key[0])
        yield frame

    def _forget(self, watermark: int) -> None:
        """Drop the pause of an instance that has been silent for the idle time."""
        if self.idle_ms is not None and self.pause.exists():
            _, _, seen = self.pause.get()
            if seen // 1000 + 1 + self.idle_ms <= watermark:
                self.pause.clear()

    def close(self) -> None:
        pass


def lag_throttle_stream(
    samples: DataFrame, max_lag: int, wait_s: int = DEFAULT_LAG_WAIT_S, watermark: str = "1 minute", poll: str | None = POLL_INTERVAL,
    idle_s: int | None = None,
) -> DataFrame:
    """Verdicts as ``lag_throttle`` gives them, each emitted once the watermark has passed its sample.

    Samples are first reduced to the largest lag per ``poll`` interval, before
    the shuffle: an instance that sends a large share of all samples then reaches
    its single state as one row per interval, stamped with the last instant of
    it. ``poll=None`` judges every sample. An instance that is silent for
    ``idle_s`` seconds of event time is forgotten, its pause and stop with it;
    without it, one small row per instance stays for good. Needs the RocksDB
    state store (``spark.sql.streaming.stateStore.providerClass``). Run in append
    mode.
    """
    lags = sample_lag(samples).withColumn("lag_bytes", F.coalesce("lag_bytes", F.lit(_NO_REPLAY)))
    lags = lags.withWatermark("ts", watermark)
    if poll is not None:
        worst = lags.groupBy("instance_id", F.window("ts", poll)).agg(F.max("lag_bytes").alias("lag_bytes"))
        lags = worst.select("instance_id", F.window_time("window").alias("ts"), "lag_bytes")
    return lags.groupBy("instance_id").transformWithStateInPandas(
        _Throttle(max_lag, wait_s, None if idle_s is None else idle_s * 1000), outputStructType=_SCHEMA, outputMode="Append", timeMode="EventTime",
    )
