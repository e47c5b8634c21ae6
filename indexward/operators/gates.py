"""Whether an instance, or a single index, may be worked on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lsn_diff, validate_bloat_threshold, validate_threads
from ..keys import fleet_keys
from ..schemas import DEFAULT_MAINTENANCE_WORKERS, MAX_IO_CONCURRENCY


def is_active_vacuum(own_pid: Column | int | None = None) -> Column:
    """Condition on activity rows. Background workers, whose text starts with another word, do not count."""
    running = (F.col("state") == "active") & F.lower("query").startswith("vacuum")
    return running if own_pid is None else running & (F.col("pid") != own_pid)


def _any_per_instance(df: DataFrame, condition: Column, flag: str) -> DataFrame:
    return df.groupBy(*fleet_keys(df)).agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias(flag))


def active_vacuum(activity: DataFrame, own_pid: Column | int | None = None) -> DataFrame:
    """Per instance: is a manual vacuum running."""
    return _any_per_instance(activity, is_active_vacuum(own_pid), "active_vacuum")


def inactive_slots(slots: DataFrame) -> DataFrame:
    """Per instance: is a replication slot inactive."""
    return _any_per_instance(slots, ~F.col("active"), "inactive_replication_slots")


def sync_standby(replication: DataFrame) -> DataFrame:
    """Per instance: is a standby connected synchronously."""
    return _any_per_instance(replication, F.col("sync_state") == "sync", "sync_replication_connection")


def preflight_gates(
    activity: DataFrame, slots: DataFrame, replication: DataFrame, own_pid: Column | int | None = None
) -> DataFrame:
    """The three checks per instance. An instance without rows in a relation passes that check.

    The relations are reduced to flags and folded by a single aggregation.
    """
    no = F.lit(False)
    lead = fleet_keys(activity, slots, replication)

    def flags(df: DataFrame, vacuum: Column, slot: Column, sync: Column) -> DataFrame:
        return df.select(
            *lead, vacuum.alias("active_vacuum"), slot.alias("inactive_replication_slots"),
            sync.alias("sync_replication_connection"),
        )

    rows = flags(activity, is_active_vacuum(own_pid), no, no)
    rows = rows.unionByName(flags(slots, no, ~F.col("active"), no))
    rows = rows.unionByName(flags(replication, no, no, F.col("sync_state") == "sync"))
    names = ("active_vacuum", "inactive_replication_slots", "sync_replication_connection")
    return rows.groupBy(*lead).agg(*[F.coalesce(F.bool_or(n), no).alias(n) for n in names])


def preflight_reason(
    gates: DataFrame, skip_active_vacuums: bool = False, skip_inactive_slots: bool = False, skip_sync_replication: bool = False
) -> DataFrame:
    """Add ``skip_reason``: the failed checks that are not waived, or null to go on."""
    checks = (
        ("active_vacuum", skip_active_vacuums, "active vacuum"),
        ("inactive_replication_slots", skip_inactive_slots, "inactive replication slots"),
        ("sync_replication_connection", skip_sync_replication, "sync replication connection"),
    )
    reasons = [F.when(F.col(flag), F.lit(text)) for flag, waived, text in checks if not waived]
    text = F.concat_ws(", ", *reasons) if reasons else F.lit("")
    return gates.withColumn("skip_reason", F.nullif(text, F.lit("")))


def below_bloat_gate(percent: int | None, bloat: Column) -> Column:
    """True when an index is skipped for too little bloat. No threshold lets all pass."""
    limit = validate_bloat_threshold(percent)
    return F.lit(False) if limit is None else F.coalesce(bloat, F.lit(0.0)) < F.lit(float(limit))


def max_replica_lag(replication: DataFrame, instances: DataFrame | None = None) -> DataFrame:
    """Largest lag in bytes per instance and sample time; 0 without a standby that has replayed.

    With ``instances`` (one row per instance and sample time), those without any sample get 0.
    """
    keys = [*fleet_keys(replication), *(["ts"] if "ts" in replication.columns else [])]
    lag = F.max(lsn_diff(F.col("sent_lsn"), F.col("replay_lsn")))
    rows = replication.groupBy(*keys).agg(F.coalesce(lag, F.lit(0)).cast("bigint").alias("max_lag_bytes"))
    if instances is None:
        return rows
    on = [k for k in keys if k in instances.columns]
    return instances.join(rows, on, "left").withColumn("max_lag_bytes", F.coalesce("max_lag_bytes", F.lit(0)))


def settings_audit(settings: DataFrame, threads: int, max_parallel_maintenance_workers: int) -> DataFrame:
    """Per instance: would a run with these arguments fit its settings.

    Asking for 0 maintenance workers means the server default of 2. One pass: the
    name/value rows are pivoted by conditional aggregates.
    """
    lanes = validate_threads(threads)
    wanted = max_parallel_maintenance_workers
    effective = wanted or DEFAULT_MAINTENANCE_WORKERS

    def value(name: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.try_to_number("setting", F.lit("S9999999999999999999")))).cast("bigint")

    rows = settings.groupBy(*fleet_keys(settings)).agg(
        value("max_parallel_workers").alias("max_parallel_workers"),
        value("temp_file_limit").alias("temp_file_limit"),
        value("maintenance_io_concurrency").alias("maintenance_io_concurrency"),
    )
    workers = F.col("max_parallel_workers")
    return rows.select(
        "*",
        (F.lit(lanes * effective) <= workers).alias("total_workers_ok"),
        ((F.lit(wanted) < workers) & (F.lit(wanted) < F.floor(workers / 2))).alias("maintenance_workers_ok"),
        (F.col("maintenance_io_concurrency") <= MAX_IO_CONCURRENCY).alias("io_concurrency_ok"),
        (F.col("temp_file_limit") == -1).alias("temp_file_unlimited"),
    )
