"""Positions in the write-ahead log: ``'16/B374D848'`` is an unsigned 64-bit number in two hexadecimal halves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lsn_bytes(lsn: Column) -> Column:
    """Position as a byte offset. Decimal, because it does not fit a signed long."""
    def half(part: int) -> Column:
        return F.conv(F.split_part(lsn, F.lit("/"), F.lit(part)), 16, 10).cast("decimal(20,0)")

    return (half(1) * F.lit(1 << 32) + half(2)).cast("decimal(20,0)")


def lsn_diff(newer: Column, older: Column) -> Column:
    """Bytes between two positions; null when either is null."""
    return (lsn_bytes(newer) - lsn_bytes(older)).cast("decimal(21,0)")
