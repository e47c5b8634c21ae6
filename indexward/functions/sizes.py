"""Sizes and size changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size_gb_text(size: Column) -> Column:
    """Bytes as gibibytes with two decimals and ``' GB'``, rounded half up exactly.

    Integer arithmetic on the whole and fractional gibibytes: no double rounding, no overflow.
    """
    fraction = size.bitwiseAND(F.lit((1 << 30) - 1))
    hundredths = F.shiftright(fraction * F.lit(100) + F.lit(1 << 29), 30)
    total = F.shiftright(size, 30) * F.lit(100) + hundredths
    return F.concat((total.cast("decimal(20,0)") / F.lit(100)).cast("decimal(20,2)").cast("string"), F.lit(" GB"))


def size_pretty(size: Column) -> Column:
    """Bytes in the first unit that keeps the number below 10240, as PostgreSQL prints sizes.

    Below 10240 the bytes are exact. Larger units keep one extra bit and round it half up.
    """
    magnitude = F.abs(size)
    sign = F.when(size < 0, F.lit(-1)).otherwise(F.lit(1))
    text = F.when(magnitude < 10 * 1024, F.concat(size.cast("string"), F.lit(" bytes")))
    units = ("kB", "MB", "GB", "TB", "PB")
    for step, unit in enumerate(units):
        doubled = F.shiftright(magnitude, 9 + 10 * step)
        label = F.concat((sign * F.shiftright(doubled + 1, 1)).cast("string"), F.lit(" " + unit))
        text = text.otherwise(label) if unit == units[-1] else text.when(doubled < 20 * 1024 - 1, label)
    return F.when(size.isNotNull(), text)


def size_change_pct(before: Column, after: Column) -> Column:
    """Share of ``before`` that was reclaimed, in percent; 0 when ``before`` is not positive."""
    change = (before - after).cast("double") / before.cast("double") * F.lit(100.0)
    return F.when(before.isNull() | after.isNull(), F.lit(None)).when(before > 0, change).otherwise(F.lit(0.0))


def round1(value: Column) -> Column:
    """One decimal, half away from zero, as a 4-byte real."""
    return (F.round(value * F.lit(10.0)) / F.lit(10.0)).cast("float")
