"""Replication lag per poll interval. The same code serves batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lsn_diff

POLL_INTERVAL = "5 seconds"


def series_keys(samples: DataFrame) -> list[str]:
    """Key of one lag series: the instance."""
    return [k for k in ("instance_id",) if k in samples.columns]


def sample_lag(samples: DataFrame) -> DataFrame:
    """Lag in bytes of each standby sample; null while a standby has not replayed anything."""
    lag = lsn_diff(F.col("sent_lsn"), F.col("replay_lsn")).cast("bigint")
    return samples.select(*series_keys(samples), "ts", lag.alias("lag_bytes"))


def lag_series(samples: DataFrame, poll: str = POLL_INTERVAL, watermark: str | None = None) -> DataFrame:
    """Largest lag per instance and poll interval.

    On a stream ``watermark`` says how late samples may be; intervals are
    emitted once they are closed.
    """
    lags = sample_lag(samples)
    if watermark is not None:
        lags = lags.withWatermark("ts", watermark)
    keys = series_keys(samples)
    worst = F.coalesce(F.max("lag_bytes"), F.lit(0))
    rows = lags.groupBy(*keys, F.window("ts", poll)).agg(worst.alias("max_lag_bytes"))
    return rows.select(*keys, F.col("window.start").alias("poll_start"), "max_lag_bytes")
