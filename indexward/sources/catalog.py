"""Snapshots of catalog and activity relations."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..keys import FLEET_KEYS, fleet_keys
from ..schemas import ACTIVITY_RELATIONS, CATALOG

_FLEET_TYPES = {"instance_id": T.LongType(), "database_name": T.StringType(), "snapshot_ts": T.TimestampType()}


def _with_fleet(schema: T.StructType, fleet: tuple[str, ...]) -> T.StructType:
    known = {f.name for f in schema.fields}
    lead = [T.StructField(k, _FLEET_TYPES[k], True) for k in FLEET_KEYS if k in fleet and k not in known]
    return T.StructType([*lead, *schema.fields])


def _load(spark: SparkSession, path: str, relations: Mapping[str, T.StructType], fleet: tuple[str, ...]):
    root = path.rstrip("/")
    return {
        name: spark.read.schema(_with_fleet(schema, fleet)).parquet(f"{root}/{name}") for name, schema in relations.items()
    }


def load_catalog(spark: SparkSession, path: str, fleet: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Catalog relations from ``path/<relation>`` (parquet), with fixed schemas.

    ``fleet`` names the leading key columns the snapshots carry. A statistics
    snapshot from a server without ``last_idx_scan`` reads as nulls.
    """
    return _load(spark, path, CATALOG, fleet)


def load_activity(spark: SparkSession, path: str, fleet: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Activity, replication slot, setting and replication relations from ``path/<relation>``."""
    return _load(spark, path, ACTIVITY_RELATIONS, fleet)


# The column each large relation is bucketed by: the object it describes.
_BUCKET_BY = {"class": "oid", "index": "indexrelid", "stat_index": "indexrelid"}


def save_catalog_tables(cat: Mapping[str, DataFrame], path: str, prefix: str, buckets: int) -> None:
    """Save a snapshot as tables ``<prefix>_<relation>`` below ``path``, the large ones bucketed by object id.

    All inventories join on these ids. Reading the tables back, the joins of
    index, index class and statistics need no shuffle, and the join to the
    table class shuffles one side only. Fleet keys lead the bucket columns.
    """
    for name, rows in cat.items():
        by = [*fleet_keys(rows), _BUCKET_BY[name]] if name in _BUCKET_BY else []
        writer = (rows.repartition(buckets, *by) if by else rows).write
        if by:
            writer = writer.bucketBy(buckets, *by).sortBy(*by)
        writer.mode("overwrite").option("path", f"{path.rstrip('/')}/{name}").saveAsTable(f"{prefix}_{name}")


def load_catalog_tables(spark: SparkSession, prefix: str) -> dict[str, DataFrame]:
    """A snapshot saved by ``save_catalog_tables``."""
    return {name: spark.table(f"{prefix}_{name}") for name in CATALOG}


# What is read from one live database. Sizes are taken on the server; the object ids split the read.
_REMOTE = {
    "namespace": ("oid", "SELECT oid::bigint AS oid, nspname::text AS nspname FROM pg_namespace"),
    "am": ("oid", "SELECT oid::bigint AS oid, amname::text AS amname FROM pg_am"),
    "class": (
        "oid",
        "SELECT oid::bigint AS oid, relname::text AS relname, relnamespace::bigint AS relnamespace,"
        " relkind::text AS relkind, relam::bigint AS relam, relpages::bigint AS relpages,"
        " reltuples::bigint AS reltuples, pg_relation_size(oid) AS relsize FROM pg_class",
    ),
    "index": (
        "indexrelid",
        "SELECT indexrelid::bigint AS indexrelid, indrelid::bigint AS indrelid, indisprimary, indisunique, indisvalid,"
        " indisready, indislive FROM pg_index",
    ),
    "stat_index": (
        "indexrelid",
        "SELECT indexrelid::bigint AS indexrelid, idx_scan, last_idx_scan FROM pg_stat_user_indexes",
    ),
    "inherits": ("inhrelid", "SELECT inhrelid::bigint AS inhrelid, inhparent::bigint AS inhparent FROM pg_inherits"),
}


def oid_bounds_sql(relation: str, partitions: int) -> str:
    """A statement whose one row has the object ids that cut a relation into ``partitions`` parts of equal size."""
    column, select = _REMOTE[relation]
    source = select.rpartition(" FROM ")[2]
    shares = ", ".join(f"{i / partitions:.6f}" for i in range(1, partitions))
    return f"SELECT percentile_disc(ARRAY[{shares}]) WITHIN GROUP (ORDER BY {column}::bigint) AS bounds FROM {source}"


def oid_predicates(column: str, bounds: Sequence[int]) -> list[str]:
    """Conditions that deal all object ids to parts: below the first bound, between neighbours, from the last on."""
    cuts = sorted(set(bounds))
    if not cuts:
        return ["TRUE"]
    between = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} < {cuts[0]}", *between, f"{column} >= {cuts[-1]}"]


def snapshot_session(snapshot: str) -> dict[str, str]:
    """Reader options under which each connection sees the exported server snapshot.

    The statement opens the transaction of the read, so it needs cursors (``fetchsize``), with which the reader leaves
    autocommit.
    """
    if not re.fullmatch(r"[0-9A-Fa-f-]+", snapshot):
        raise ValueError(f"not a snapshot id: '{snapshot}'")
    statement = f"SET TRANSACTION ISOLATION LEVEL REPEATABLE READ READ ONLY; SET TRANSACTION SNAPSHOT '{snapshot}'"
    return {"sessionInitStatement": statement, "fetchsize": "10000"}


def load_catalog_jdbc(
    spark: SparkSession, url: str, properties: dict[str, str], max_oid: int | None = None, partitions: int = 8, old_server: bool = False,
    snapshot: str | None = None, bounds: Mapping[str, Sequence[int]] | None = None,
) -> dict[str, DataFrame]:
    """Catalog relations of one live database, read in parallel by object id.

    ``snapshot`` is an id from ``pg_export_snapshot()`` in a transaction that the caller keeps open while the relations are
    read; all of them then show the same moment. ``bounds`` has object ids per relation (as ``oid_bounds_sql`` finds them) that
    cut it into parts of equal size; other relations are cut into equal strides up to ``max_oid``, which old and busy servers
    fill unevenly. ``old_server`` leaves out the last-scan column. Needs the JDBC driver on the class path.
    """
    properties = {**properties, **(snapshot_session(snapshot) if snapshot else {})}
    frames = {}
    for name, (split_by, select) in _REMOTE.items():
        if old_server:
            select = select.replace(", last_idx_scan", "")
        table = f"({select}) AS snapshot"
        if bounds and name in bounds:
            frames[name] = spark.read.jdbc(url, table, predicates=oid_predicates(split_by, bounds[name]), properties=properties)
        elif max_oid is None:
            raise ValueError(f"neither bounds nor the largest object id are given for {name}")
        else:
            frames[name] = spark.read.jdbc(
                url, table, column=split_by, lowerBound=0, upperBound=max_oid, numPartitions=partitions, properties=properties
            )
    frames["stat_index"] = with_scan_compat(frames["stat_index"])
    return frames


# What the server knows about its own activity; a few rows per connection, slot, setting and standby.
_REMOTE_ACTIVITY = {
    "activity": "SELECT pid::bigint AS pid, state::text AS state, query::text AS query FROM pg_stat_activity",
    "slots": "SELECT slot_name::text AS slot_name, active FROM pg_replication_slots",
    "settings": "SELECT name::text AS name, setting::text AS setting FROM pg_settings",
    "repl_samples": (
        "SELECT application_name::text AS standby, now() AS ts, sent_lsn::text AS sent_lsn,"
        " replay_lsn::text AS replay_lsn, sync_state::text AS sync_state FROM pg_stat_replication"
    ),
}


def load_activity_jdbc(spark: SparkSession, url: str, properties: dict[str, str], instance_id: int | None = None) -> dict[str, DataFrame]:
    """Activity relations of one live server, with the layout of ``load_activity``. Needs the JDBC driver on the class path."""
    frames = {}
    for name, select in _REMOTE_ACTIVITY.items():
        rows = spark.read.jdbc(url, f"({select}) AS snapshot", properties=properties)
        frames[name] = rows.withColumn("instance_id", F.lit(instance_id).cast("bigint")).select(*ACTIVITY_RELATIONS[name].names)
    return frames


def with_scan_compat(stats: DataFrame) -> DataFrame:
    """Index statistics with a ``last_idx_scan`` column, null where the server has none."""
    if "last_idx_scan" in stats.columns:
        return stats
    return stats.withColumn("last_idx_scan", F.lit(None).cast("timestamp"))


def is_missing_path(error: AnalysisException) -> bool:
    """True for the error of reading a path that does not exist (yet)."""
    return error.getCondition() == "PATH_NOT_FOUND"
