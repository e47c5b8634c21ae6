"""The last row of each key without sorting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types whose values fit in a fixed-width aggregation buffer.
_FIXED = ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz", "boolean")


def is_fixed(rows: DataFrame, columns: Sequence[str]) -> bool:
    """Whether the largest value of these columns can be found by a hash aggregate."""
    types = dict(rows.dtypes)
    return all(types[c] in _FIXED for c in columns)


def last_per_key(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Column) -> DataFrame:
    """One row per key with ``columns`` of the row that is largest by ``order``, a number or a time; of equal ones any.

    An aggregate that carries texts has to sort its input. Here it carries the order and a hash of the payload, in fixed width,
    and is combined before the shuffle; the payload is then fetched by key, order and hash, and equal copies fall together.
    """
    tagged = rows.select(*keys, *columns, order.alias("_order"), F.xxhash64(*columns).alias("_tag"))
    best = tagged.groupBy(*keys).agg(F.max("_order").alias("_order"), F.max_by("_tag", "_order").alias("_tag"))
    return tagged.join(best.hint("shuffle_hash"), [*keys, "_order", "_tag"]).select(*keys, *columns).distinct()
