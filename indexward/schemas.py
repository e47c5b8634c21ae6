"""Canonical table definitions, fixed domains and fixed limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_LONG, _INT, _STR, _BOOL = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()
_TS, _FLOAT, _DOUBLE = T.TimestampType(), T.FloatType(), T.DoubleType()

# Outcome and state domains.
OUTCOMES = ("invalid_index", "below_bloat_threshold", "skipped", "excluded", "validation_failed", "failed", "success")
STATES = ("pending", "in_progress", "completed", "failed", "skipped")

# Limits.
MAX_THREADS = 32
MAX_SCHEMAS = 512
MAX_WORK_MEM_GB = 32
MAX_IO_CONCURRENCY = 512
DEFAULT_MAINTENANCE_WORKERS = 2
LAST_ATTEMPT = 3
DEFAULT_LAG_WAIT_S = 1800
LAG_WARN_EVERY_S = 60

NAMESPACE = _struct(oid=_LONG, nspname=_STR)
AM = _struct(oid=_LONG, amname=_STR)
CLASS = _struct(
    oid=_LONG, relname=_STR, relnamespace=_LONG, relkind=_STR, relam=_LONG, relpages=_LONG, reltuples=_LONG, relsize=_LONG
)
INDEX = _struct(
    indexrelid=_LONG, indrelid=_LONG, indisprimary=_BOOL, indisunique=_BOOL, indisvalid=_BOOL, indisready=_BOOL,
    indislive=_BOOL,
)
STAT_INDEX = _struct(indexrelid=_LONG, idx_scan=_LONG, last_idx_scan=_TS)
INHERITS = _struct(inhrelid=_LONG, inhparent=_LONG)

CATALOG = {
    "namespace": NAMESPACE,
    "am": AM,
    "class": CLASS,
    "index": INDEX,
    "stat_index": STAT_INDEX,
    "inherits": INHERITS,
}

ACTIVITY = _struct(instance_id=_LONG, pid=_LONG, state=_STR, query=_STR)
SLOTS = _struct(instance_id=_LONG, slot_name=_STR, active=_BOOL)
SETTINGS = _struct(instance_id=_LONG, name=_STR, setting=_STR)
REPLICATION = _struct(
    instance_id=_LONG, standby=_STR, ts=_TS, sent_lsn=_STR, replay_lsn=_STR, sync_state=_STR
)
ATTEMPTS = _struct(index_oid=_LONG, attempt=_INT, started_at=_TS, duration_s=_LONG, error=_STR)
AFTER_SNAPSHOT = _struct(oid=_LONG, after_size=_LONG, healthy_after=_BOOL)

ACTIVITY_RELATIONS = {
    "activity": ACTIVITY,
    "slots": SLOTS,
    "settings": SETTINGS,
    "repl_samples": REPLICATION,
}

LOGBOOK_SCHEMA = _struct(
    schema_name=_STR, index_name=_STR, index_type=_STR, reindex_time=_TS, reindex_status=_STR, before_size=_LONG,
    after_size=_LONG, size_change=_FLOAT, reindex_duration=_FLOAT,
)
STATE_SCHEMA = _struct(
    schema_name=_STR, table_name=_STR, index_name=_STR, index_type=_STR, state=_STR, session_id=_STR, created_at=_TS,
    updated_at=_TS,
)
LOG_EVENT_SCHEMA = _struct(
    timestamp=_STR, level=_STR, message=_STR, schema=_STR, index_name=_STR, index_type=_STR, status=_STR,
    duration_secs=_DOUBLE, total_indexes=_LONG, current_index=_LONG, failed_count=_LONG, thread_count=_LONG, error=_STR,
    maintenance_work_mem_gb=_LONG, max_parallel_maintenance_workers=_LONG, maintenance_io_concurrency=_LONG,
    lock_timeout_seconds=_LONG, min_size_gb=_LONG, max_size_gb=_LONG,
)


FLEET_SCHEMA = _struct(instance_id=_LONG, database_name=_STR, snapshot_ts=_TS)


def empty_state(spark: SparkSession, fleet: Sequence[str] = ()) -> DataFrame:
    """A state table without rows, with the leading keys of a fleet that are named."""
    lead = [f for f in FLEET_SCHEMA.fields if f.name in fleet]
    return spark.createDataFrame([], T.StructType([*lead, *STATE_SCHEMA.fields]))


def empty_logbook(spark: SparkSession) -> DataFrame:
    """A logbook without rows."""
    return spark.createDataFrame([], LOGBOOK_SCHEMA)
