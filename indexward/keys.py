"""Optional leading key columns.

Catalog snapshots of one database carry none of these columns. Snapshots of a
fleet carry some or all of them, and every join, window and de-duplication then
includes those that both sides have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

FLEET_KEYS = ("instance_id", "database_name", "snapshot_ts")


def fleet_keys(*frames: DataFrame) -> list[str]:
    """Leading keys present in every one of ``frames``, in canonical order."""
    return [k for k in FLEET_KEYS if all(k in f.columns for f in frames)]


def same_fleet(left: DataFrame, right: DataFrame) -> list[str]:
    """Leading keys of two frames that belong together; an error if one has a key that the other lacks."""
    if fleet_keys(left) != fleet_keys(right):
        raise ValueError(f"leading keys differ: {fleet_keys(left)} and {fleet_keys(right)}")
    return fleet_keys(left)


def index_keys(*frames: DataFrame) -> list[str]:
    """Key of one index: the shared leading keys, then schema and index name."""
    return [*fleet_keys(*frames), "schema_name", "index_name"]


def table_keys(*frames: DataFrame) -> list[str]:
    """Key of one table: the shared leading keys, then schema and table name."""
    return [*fleet_keys(*frames), "schema_name", "table_name"]
