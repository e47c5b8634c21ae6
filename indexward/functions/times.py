"""Timestamps as text and as epoch seconds. All texts are in UTC whatever the session zone is."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _in_utc(ts: Column) -> Column:
    return F.to_utc_timestamp(ts, F.current_timezone())


def last_scan_iso(ts: Column) -> Column:
    """``2001-11-04T00:00:00Z``"""
    return F.date_format(_in_utc(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def log_timestamp(ts: Column) -> Column:
    """``2001-11-04 00:00:00.000``"""
    return F.date_format(_in_utc(ts), "yyyy-MM-dd HH:mm:ss.SSS")


def epoch_secs(ts: Column) -> Column:
    """Whole epoch seconds, rounded to the nearest (not truncated)."""
    return F.round(F.unix_micros(ts) / F.lit(1e6)).cast("bigint")


def as_timestamp(now: dt.datetime | Column) -> Column:
    """An instant argument as a timestamp column. Naive datetimes are taken as UTC."""
    if isinstance(now, Column):
        return now
    aware = now if now.tzinfo else now.replace(tzinfo=dt.timezone.utc)
    micros = (aware - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros))


def as_epoch(now: dt.datetime | int | Column) -> Column:
    """An instant argument as whole epoch seconds."""
    if isinstance(now, Column):
        return now
    return F.lit(now).cast("bigint") if isinstance(now, int) else epoch_secs(as_timestamp(now))
