"""When lag should pause or stop the work of an instance, over recorded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DEFAULT_LAG_WAIT_S, LAG_WARN_EVERY_S
from ..sources.scratch import materialize
from .lag import series_keys


def lag_throttle(
    lags: DataFrame, max_lag: int, wait_s: int = DEFAULT_LAG_WAIT_S, bucket_s: int = 3600
) -> DataFrame:
    """Add ``action``, ``waited_s`` and ``warn`` to the lag of each instance and time.

    ``lags`` has one row per instance and ``ts`` with ``max_lag_bytes`` (null for
    an unreadable sample). Lag above ``max_lag`` starts or continues a pause; any
    other sample ends it. A pause that lasts ``wait_s`` stops the instance for
    good. A warning is due at the start of a pause and on whole minutes.

    The series of one instance may be long, so it is cut into time buckets.
    Rows only ever meet inside a bucket; what crosses its border (the start of
    the open pause, the stop) is carried over the much smaller bucket summaries.
    The buckets are written once, so the passes for summary, stops and result
    neither sort nor shuffle the series again.
    """
    keys = series_keys(lags)
    part = [*keys, "_bucket"]
    rows = materialize(_inside_buckets(lags, part, max_lag, bucket_s), "lag-buckets")
    carried = _carried_starts(rows, keys, part)

    # Only what is above the limit can stop an instance.
    over = rows.filter("_over").join(carried, part, "left")
    stops = over.withColumn("_waited", _waited()).filter(F.col("_waited") >= wait_s)
    stops = stops.groupBy(*keys).agg(F.min("ts").alias("_stop_ts"))
    marks = rows.groupBy(*part).agg(F.max("ts").alias("_until"))
    marks = marks.join(carried, part, "left")
    if keys:
        marks = marks.join(stops, keys, "left")
    else:
        marks = marks.withColumn("_stop_ts", stops.select("_stop_ts").scalar())
    marks = marks.withColumn("_stop_ts", F.when(F.col("_stop_ts") <= F.col("_until"), F.col("_stop_ts")))
    marks = marks.filter("_carry_in IS NOT NULL OR _stop_ts IS NOT NULL").drop("_until")

    judged = rows.join(marks, part, "left").withColumn("_waited", F.when(F.col("_over"), _waited()))
    action = (
        F.when(F.col("ts") > F.col("_stop_ts"), F.lit("stopped"))
        .when(F.col("ts") == F.col("_stop_ts"), F.lit("stop"))
        .when(F.col("_over"), F.lit("pause"))
        .otherwise(F.lit("proceed"))
    )
    judged = judged.withColumn("action", action)
    due = (F.col("action") == "pause") & (F.col("_waited") % LAG_WARN_EVERY_S == 0)
    return judged.select(
        *keys, "ts", "max_lag_bytes", "action",
        F.when(F.col("action").isin("pause", "stop"), F.col("_waited")).alias("waited_s"),
        F.coalesce(due, F.lit(False)).alias("warn"),
    )


def _waited():
    start = F.when(F.col("_was_reset"), F.col("_local_start")).otherwise(F.coalesce("_carry_in", "_local_start"))
    return F.floor((F.unix_micros("ts") - F.unix_micros(start)) / F.lit(1_000_000)).cast("bigint")


def _inside_buckets(lags: DataFrame, part: list[str], max_lag: int, bucket_s: int) -> DataFrame:
    """Per row: start of its pause as far as its own bucket shows, and whether a pause ended in it before."""
    rows = lags.withColumns({
        "_over": F.coalesce(F.col("max_lag_bytes") > max_lag, F.lit(False)),
        "_bucket": F.floor(F.unix_micros("ts") / F.lit(bucket_s * 1_000_000)).cast("bigint"),
    })
    inside = Window.partitionBy(*part).orderBy("ts")
    begins = F.col("_over") & ~F.coalesce(F.lag("_over").over(inside), F.lit(False))
    rows = rows.withColumn("_begin", F.when(begins, F.col("ts")))
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({
        "_local_start": F.last("_begin", ignorenulls=True).over(so_far),
        "_was_reset": F.max(~F.col("_over")).over(so_far),
    }).drop("_begin")


def _carried_starts(rows: DataFrame, keys: list[str], part: list[str]) -> DataFrame:
    """Per bucket that begins inside a pause: the start of that pause."""
    summary = rows.groupBy(*part).agg(
        F.max("_was_reset").alias("_has_reset"),
        F.max_by(F.when(F.col("_over"), F.col("_local_start")), "ts").alias("_open_start"),
    )
    along = Window.partitionBy(*keys).orderBy("_bucket")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summary = summary.withColumn("_island", F.count_if("_has_reset").over(so_far))
    in_island = Window.partitionBy(*keys, "_island").orderBy("_bucket")
    in_island = in_island.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summary = summary.withColumn("_carry_out", F.min("_open_start").over(in_island))
    carried = summary.withColumn("_carry_in", F.lag("_carry_out").over(along))
    return carried.filter("_carry_in IS NOT NULL").select(*part, "_carry_in")
