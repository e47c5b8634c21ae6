"""The two bloat measures. They are unrelated and answer different questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def estimated_bloat(index_pages: Column, index_tuples: Column, table_pages: Column, table_tuples: Column) -> Column:
    """Page share minus tuple share of an index in its table, in percent, never negative.

    Zero unless the table has both pages and tuples. Used for ranking.
    """
    page_share = F.try_divide(index_pages.cast("double"), table_pages.cast("double")) * F.lit(100.0)
    tuple_share = F.try_divide(index_tuples.cast("double"), table_tuples.cast("double")) * F.lit(100.0)
    known = (table_pages > 0) & (table_tuples > 0)
    return F.coalesce(F.when(known, F.greatest(F.lit(0.0), page_share - tuple_share)), F.lit(0.0))


def page_drift_bloat(index_pages: Column, table_pages: Column, index_size: Column, table_size: Column) -> Column:
    """Page share minus size share, in percent, two decimals, may be negative. Used by the bloat gate.

    Decimal arithmetic. A table of size zero gives 0.
    """
    wide = "decimal(19,0)"
    page_share = F.try_divide(index_pages.cast(wide), table_pages.cast(wide)) * F.lit(100)
    size_share = F.try_divide(index_size.cast(wide), table_size.cast(wide)) * F.lit(100)
    known = (table_pages > 0) & (index_pages > 0)
    return F.coalesce(F.when(known, F.round(page_share - size_share, 2).cast("double")), F.lit(0.0))
