"""Ranked worklists as files. Part files are in rank order, and so are the rows inside each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import csv_quote, parse_plan_format
from ..keys import fleet_keys

PLAN_COLUMNS = (
    "rank", "schema_name", "table_name", "index_name", "index_type", "size_bytes", "size_pretty", "scan_count", "last_scan",
    "estimated_bloat_percent",
)


def _in_rank_order(plan: DataFrame, in_order: bool) -> DataFrame:
    lead = fleet_keys(plan)
    rows = plan.select(*lead, *PLAN_COLUMNS)
    return rows if in_order else rows.orderBy(*lead, "rank")


def write_plan_json(plan: DataFrame, path: str, compression: str | None = None, in_order: bool = False) -> None:
    """JSON Lines. A missing last scan stays as an explicit null. ``in_order``: the rows come in rank order already."""
    _in_rank_order(plan, in_order).write.option("ignoreNullFields", False).json(path, compression=compression)


def write_plan_csv(plan: DataFrame, path: str, compression: str | None = None, in_order: bool = False) -> None:
    """CSV with a header. Inner quotes are doubled, spaces kept, nulls empty, bloat with two decimals."""
    bloat = F.round("estimated_bloat_percent", 2).cast("decimal(20,2)")
    options = {
        "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
        "nullValue": "", "emptyValue": "",
    }
    rows = _in_rank_order(plan, in_order).withColumn("estimated_bloat_percent", bloat)
    rows.write.options(**options).csv(path, compression=compression)


def write_plan(plan: DataFrame, path: str, fmt: str = "json", compression: str | None = None, in_order: bool = False) -> None:
    """Write in the named format, as plain text or with one of Spark's codecs for text files."""
    {"json": write_plan_json, "csv": write_plan_csv}[parse_plan_format(fmt)](plan, path, compression, in_order)


def plan_csv_lines(plan: DataFrame) -> DataFrame:
    """The same rows as finished text lines ``(rank, line)``, for sinks other than files."""
    text = [F.coalesce(csv_quote(F.col(c).cast("string")), F.lit("")) for c in PLAN_COLUMNS[:-1]]
    bloat = F.round("estimated_bloat_percent", 2).cast("decimal(20,2)").cast("string")
    return plan.select(*fleet_keys(plan), "rank", F.concat_ws(",", *text, bloat).alias("line"))
