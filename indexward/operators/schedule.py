"""From an inventory to a worklist: exclusions, schedule and command list."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import as_timestamp, is_temp_rebuild_name, parse_index_kind, rebuild_command, validate_threads
from ..keys import fleet_keys, table_keys
from .ranking import HOT_GROUP_ROWS, number_rows, rank_within


class Split(NamedTuple):
    """Result of ``split_excluded``."""

    logbook: DataFrame
    state_updates: DataFrame
    worklist: DataFrame


def split_excluded(inventory: DataFrame, names: Sequence[str] | DataFrame, kind: str, now) -> Split:
    """Excluded indexes as logbook rows and state updates; the rest, without rebuild leftovers, as the worklist.

    The logbook records the name of the kind filter as index type. Pass an
    inventory read from a table when it is expensive: each result is one pass over it.
    """
    if isinstance(names, DataFrame):
        listed = names.select("index_name").distinct()
        excluded = inventory.join(listed, "index_name", "left_semi")
        kept = inventory.join(listed, "index_name", "left_anti")
    else:
        hit = F.col("index_name").isin(list(names)) if names else F.lit(False)
        excluded, kept = inventory.filter(hit), inventory.filter(~hit)
    excluded, kept = excluded.select(*inventory.columns), kept.select(*inventory.columns)
    lead = fleet_keys(inventory)
    nothing = {"before_size": "bigint", "after_size": "bigint", "size_change": "float", "reindex_duration": "float"}
    logbook = excluded.select(
        *lead, "schema_name", "index_name", F.lit(parse_index_kind(kind)).alias("index_type"),
        as_timestamp(now).alias("reindex_time"), F.lit("excluded").alias("reindex_status"),
        *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()],
    )
    updates = excluded.select(*lead, "schema_name", "index_name", F.lit("skipped").alias("state"))
    return Split(logbook, updates, kept.filter(~is_temp_rebuild_name(F.col("index_name"))))


def conflict_free_waves(
    worklist: DataFrame, threads: int, one_table: bool = False, hot_rows: int = HOT_GROUP_ROWS, stored: bool = False
) -> DataFrame:
    """Add ``wave`` and ``lane``. Two indexes of one table never share a wave, and a table stays on one lane.

    The wave is the position of the index in its table, by size and name. The
    lane is a digest of the table name, so it needs no shuffle and any consumer
    can recompute it. Say ``stored`` when the worklist comes from a table.
    """
    lanes = validate_threads(threads, one_table)
    keys = table_keys(worklist)
    order = [F.coalesce("size_bytes", F.lit(0)).asc(), F.asc("index_name")]
    rows = rank_within(worklist, keys, order, "wave", hot_rows, stored)
    digest = F.md5(F.concat_ws(".", *[F.col(k).cast("string") for k in keys]))
    lane = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.lit(lanes)
    return rows.withColumn("lane", lane.cast("int"))


def worklist_commands(
    worklist: DataFrame, order: Sequence[str] = ("schema_ord", "schema_name", "index_name"), concurrently: bool = True
) -> DataFrame:
    """What a dry run would print: position, total and ``[i/n] command`` in list order, per database of a fleet."""
    keys, lead = [F.asc(c) for c in order if c in worklist.columns], fleet_keys(worklist)
    if lead:
        totals = worklist.groupBy(*lead).agg(F.count(F.lit(1)).alias("total"))
        rows = rank_within(worklist, lead, keys, "position").join(totals, lead)
        rows = rows.withColumn("position", F.col("position").cast("bigint"))
    else:
        rows, total = number_rows(worklist, keys)
        rows = rows.withColumn("total", F.lit(total).cast("bigint"))
    command = rebuild_command(F.col("schema_name"), F.col("index_name"), concurrently)
    return rows.withColumn("command", F.format_string("[%d/%d] %s", F.col("position"), F.col("total"), command))
