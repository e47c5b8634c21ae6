"""One registered query per operator, over whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import (
    analyze_command, classify_error, csv_quote, epoch_secs, is_temp_rebuild_name, last_scan_iso, log_timestamp, lsn_bytes,
    rebuild_command, round1, size_change_pct, size_gb_text, size_pretty, split_list,
)
from ..operators import filters, gates, inventory, outcome, ranking, schedule, state
from ..plans.maintenance import prepare_run, record_run, resume_worklist, run_outcomes
from ..plans.ranked_plan import ranked_plan, write_ranked_plan
from ..schemas import CATALOG, empty_state
from ..sources import (
    append_logbook, load_catalog, plan_csv_lines, materialize, read_log_json, read_log_text, read_logbook, read_state, scratch_path,
    to_log_json, to_log_text, update_state, with_scan_compat, write_state,
)
from ..sources.bindings import NOW, bind, bind_catalog, stored_if_small, stored_pairs
from ..sources.logs import parse_log_lines
from ..streaming import lag_series, lag_throttle, lag_throttle_stream, state_from_changelog

Query = Callable[[SparkSession, str], DataFrame]

ALL_SCHEMAS = [f"NATION_{7 * i % 25}" for i in range(25)]
SCHEMAS = ["NATION_3", "NATION_11", "NATION_1", "NATION_7", "NATION_20"]
TABLE = "Supplier#000000007"
PARENT = "Customer#000000010"
EXCLUDED = ["Supplier#000000001_p3", "part_77_idx", "Supplier#000000004_p13_ccnew", "Part_78_idx"]
MAX_LAG, WAIT_S = 10_000_000, 21_600
STARTED, ENDED = NOW, NOW + dt.timedelta(seconds=754, milliseconds=250)
SESSION = "session-1"

# The relations that inventories, and those that lists of partitions read.
INDEXES = ("namespace", "am", "class", "index")
PARTITIONS = ("namespace", "class", "inherits")

_REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register under the function's name. Results use zone-free timestamps and 8-byte doubles."""
    return _register(function.__name__, function)


def query_as(name: str) -> Callable[[Query], Query]:
    """Register under a name of its own, where the operator's name is taken here."""
    return lambda function: _register(name, function)


def _register(name: str, function: Query) -> Query:

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = function(spark, folder)
        casts = {}
        for field in df.schema.fields:
            if isinstance(field.dataType, T.TimestampType):
                casts[field.name] = F.col(field.name).cast("timestamp_ntz")
            elif isinstance(field.dataType, T.FloatType):
                casts[field.name] = F.col(field.name).cast("double")
        return df.withColumns(casts) if casts else df

    run.__doc__ = function.__doc__
    _REGISTRY[name] = run
    return function


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


# --- inventories -----------------------------------------------------------------------------------------------------


def _read_once(spark, folder) -> inventory.Catalog:
    """The catalog for one pass over its indexes."""
    return bind_catalog(spark, folder, *INDEXES, stored=stored_if_small(spark, folder))


def _inventory(spark, folder, **arguments) -> DataFrame:
    return inventory.index_inventory(_read_once(spark, folder), **arguments).select(*inventory.INVENTORY_COLUMNS)


@query
def inv_btree(spark, folder):
    return _inventory(spark, folder, kind="btree")


@query
def inv_constraint(spark, folder):
    return _inventory(spark, folder, kind="constraint")


@query
def inv_all(spark, folder):
    return _inventory(spark, folder, kind="all")


@query
def inv_huge(spark, folder):
    """Sizes a thousand times as large: no index is too large for an inventory."""
    cat = _read_once(spark, folder)
    cat["class"] = cat["class"].withColumn("relsize", F.col("relsize") * 1000)
    return inventory.index_inventory(cat, kind="all").select(*inventory.INVENTORY_COLUMNS)


def _fleet(df: DataFrame) -> DataFrame:
    """The schema name plays the database of a fleet here."""
    return df.withColumn("database_name", F.substring("schema_name", 1, 8))


@query
def commands_fleet(spark, folder):
    rows = _fleet(inventory.index_inventory(bind_catalog(spark, folder, *INDEXES), ALL_SCHEMAS, kind="btree"))
    return schedule.worklist_commands(rows).select("database_name", "position", "total", "command")


@query
def state_merge_fleet(spark, folder):
    """The first run of a fleet: an empty state takes the worklist of every database."""
    rows = _fleet(inventory.index_inventory(_read_once(spark, folder), kind="all"))
    return state.state_merge(empty_state(spark, ["database_name"]), rows, SESSION, NOW).select("database_name", "schema_name", "index_name", "state", "session_id")


@query
def resume_fleet(spark, folder):
    """Databases with open rows go on with these; the others discover anew."""
    old = _fleet(bind(spark, folder, "state_prev")["state_prev"])
    done = F.col("database_name").isin("NATION_1", "NATION_3")
    old = old.withColumn("state", F.when(done, F.lit("completed")).otherwise(F.col("state")))
    found = _fleet(inventory.index_inventory(bind_catalog(spark, folder, *INDEXES), kind="all"))
    return resume_worklist(old, found, True, SESSION, NOW, None).worklist.select("database_name", "schema_name", "index_name")


@query
def inv_size_band(spark, folder):
    return _inventory(spark, folder, schemas=SCHEMAS, kind="all", min_gb=1, max_gb=5)


@query
def inv_one_table(spark, folder):
    return _inventory(spark, folder, table=TABLE, kind="btree")


@query
def user_schemas(spark, folder):
    return filters.user_schemas(bind_catalog(spark, folder, "namespace")["namespace"])


@query
def exists_verdicts(spark, folder):
    cat = bind_catalog(spark, folder, *PARTITIONS)
    wanted = [*SCHEMAS, "NATION_2", "NATION_16", "nation_3", "NO_SUCH"]
    probes = [inventory.existence(cat, wanted, t).withColumn("probe", F.lit(t)) for t in (TABLE, PARENT, "part_5")]
    return probes[0].unionByName(probes[1]).unionByName(probes[2])


@query
def schema_dedupe(spark, folder):
    return filters.dedupe_schemas(bind(spark, folder, "requested_schemas")["requested_schemas"])


@query
def schema_duplicates(spark, folder):
    return filters.schema_duplicates(bind(spark, folder, "requested_schemas")["requested_schemas"])


@query
def partitions(spark, folder):
    rows = inventory.table_partitions(bind_catalog(spark, folder, *PARTITIONS, stored=()))
    return rows.select("parent_schema", "parent_table_name", "partition_schema", "partition_name")


@query
def partitioned_tables(spark, folder):
    return inventory.partitioned_tables(bind_catalog(spark, folder, *PARTITIONS, stored=())).drop("schema_ord")


@query
def partition_indexes(spark, folder):
    rows = inventory.partition_indexes(bind_catalog(spark, folder, *INDEXES, "inherits"), SCHEMAS, min_gb=1, max_gb=4)
    return rows.select(*inventory.INVENTORY_COLUMNS, "parent_table_name")


@query
def inv_with_partitions(spark, folder):
    rows = inventory.inventory_union(bind_catalog(spark, folder, *INDEXES, "inherits"), kind="btree", include_partitions=True)
    return rows.select("pass", *inventory.INVENTORY_COLUMNS, "parent_table_name")


@query
def inv_with_partitions_dedup(spark, folder):
    rows = inventory.inventory_union(bind_catalog(spark, folder, *INDEXES, "inherits"), kind="btree", include_partitions=True)
    return inventory.dedupe_last_wins(rows).select(*inventory.INVENTORY_COLUMNS, "parent_table_name")


@query
def inv_one_partitioned_table(spark, folder):
    rows = inventory.inventory_union(bind_catalog(spark, folder, *INDEXES, "inherits"), None, PARENT, kind="btree", include_partitions=True)
    return rows.select("pass", *inventory.INVENTORY_COLUMNS, "parent_table_name")


@query
def order_size_desc(spark, folder):
    rows = inventory.index_inventory(bind_catalog(spark, folder, *INDEXES), ALL_SCHEMAS, kind="all").select("schema_ord", "schema_name", "index_name", "size_bytes")
    numbered, _ = ranking.number_rows(rows, inventory.size_order(rows, "desc"))
    return numbered.select("position", "schema_name", "index_name", "size_bytes")


@query
def order_size_asc(spark, folder):
    rows = inventory.index_inventory(bind_catalog(spark, folder, *INDEXES), ALL_SCHEMAS, kind="all").select("schema_ord", "schema_name", "index_name", "size_bytes")
    numbered, _ = ranking.number_rows(rows, inventory.size_order(rows, "asc"))
    return numbered.select("position", "schema_name", "index_name", "size_bytes")


@query
def index_size(spark, folder):
    views = bind(spark, folder, "state_updates")
    keys = views["state_updates"].select("schema_name", "index_name").distinct()
    extra = keys.select("schema_name", F.concat("index_name", F.lit("_gone")).alias("index_name"))
    return inventory.index_size(bind_catalog(spark, folder, *INDEXES), keys.union(extra))


@query
def integrity(spark, folder):
    cat = bind_catalog(spark, folder, *INDEXES, stored=stored_pairs(spark, folder))
    keys = inventory.index_inventory(cat, kind="all").select("schema_name", "table_name", "index_name")
    keys = materialize(keys, "integrity-keys")
    lost = keys.withColumn("index_name", F.concat("index_name", F.lit("_gone")))
    return inventory.index_integrity(cat, keys.union(lost), by_table=True, stored=True).drop("table_name")


@query
def temp_rebuild_candidates(spark, folder):
    cat = bind_catalog(spark, folder, *INDEXES)
    rows = inventory.temp_rebuild_candidates(cat, inventory.index_inventory(cat, kind="all"))
    return rows.select("schema_name", "table_name", "index_name", "healthy")


@query
def drop_excluded(spark, folder):
    rows = inventory.index_inventory(_read_once(spark, folder), kind="all")
    kept = filters.drop_temp_rebuilds(filters.drop_excluded(rows, EXCLUDED))
    return kept.select("schema_name", "index_name")


@query
def excluded_split(spark, folder):
    rows = inventory.index_inventory(bind_catalog(spark, folder, *INDEXES), kind="all")
    split = schedule.split_excluded(rows, EXCLUDED, "all", NOW)
    log = split.logbook.select(
        F.lit("logbook").alias("part"), "schema_name", "index_name", "index_type", F.col("reindex_status").alias("status"),
        "before_size",
    )
    nothing = F.lit(None).cast("bigint").alias("before_size")
    upd = split.state_updates.select(
        F.lit("state").alias("part"), "schema_name", "index_name", F.lit(None).cast("string").alias("index_type"),
        F.col("state").alias("status"), nothing,
    )
    work = split.worklist.select(
        F.lit("worklist").alias("part"), "schema_name", "index_name", "index_type", F.lit(None).cast("string").alias("status"),
        nothing,
    )
    return log.unionByName(upd).unionByName(work)


# --- ranked plans ----------------------------------------------------------------------------------------------------

PLAN_OUTPUT = (
    "rank", "schema_name", "table_name", "index_name", "index_type", "size_bytes", "size_pretty", "scan_count", "last_scan",
    "estimated_bloat_percent", "score",
)


def _read_whole(spark, folder) -> inventory.Catalog:
    """The catalog for a plan, which reads all of its relations but their flags."""
    return bind_catalog(spark, folder, stored=stored_pairs(spark, folder))


def _plan(spark, folder, sort_by, **arguments) -> DataFrame:
    return ranked_plan(_read_whole(spark, folder), arguments.pop("schemas", None), sort_by, NOW, **arguments).select(*PLAN_OUTPUT)


@query
def plan_bloat(spark, folder):
    return _plan(spark, folder, "bloat")


@query
def plan_size(spark, folder):
    return _plan(spark, folder, "size")


@query
def plan_scan_frequency(spark, folder):
    return _plan(spark, folder, "scan-frequency")


@query
def plan_age(spark, folder):
    return _plan(spark, folder, "age")


@query
def plan_bloat_size(spark, folder):
    return _plan(spark, folder, "bloat,size")


@query
def plan_all_code(spark, folder):
    return _plan(spark, folder, "bloat,size,scan-frequency,age")


@query
def plan_all_documented(spark, folder):
    return _plan(spark, folder, "bloat,size,scan-frequency,age", never_scanned="documented")


@query
def plan_repeated(spark, folder):
    """Repeated schemas repeat rows, repeated criteria count again."""
    return _plan(spark, folder, " Size , bloat,size", schemas="NATION_3, NATION_1,,NATION_3")


@query
def plan_old_server(spark, folder):
    """Statistics without the last-scan column."""
    cat = _read_whole(spark, folder)
    cat["stat_index"] = with_scan_compat(cat["stat_index"].drop("last_idx_scan"))
    return ranked_plan(cat, ALL_SCHEMAS, "age,scan-frequency", NOW).select(*PLAN_OUTPUT)


@query
def plan_fleet(spark, folder):
    """Every instance of a fleet is ranked by itself: the length of the schema name plays the instance here."""
    rows = ranking.plan_facts(_read_whole(spark, folder))
    rows = rows.withColumn("instance_id", F.length("schema_name").cast("bigint"))
    return ranking.rank_plan(rows, "size,scan-frequency", NOW).select("instance_id", *PLAN_OUTPUT)


@query
def criterion_bounds(spark, folder):
    rows = ranking.plan_inventory(_read_whole(spark, folder))
    bounds = ranking.criterion_bounds(rows, ["bloat", "size", "scan-frequency", "age"], NOW, scanned_only=True)
    return bounds.toDF(*[c.replace("-", "_") for c in bounds.columns])


@query
def page_drift_bloat(spark, folder):
    return inventory.page_drift(_read_once(spark, folder)).drop("index_oid")


def _plan_file(spark, folder, fmt) -> str:
    path = scratch_path(spark, f"plan-{fmt}")
    write_ranked_plan(_read_whole(spark, folder), path, None, "size", NOW, fmt, compression="gzip")
    return path


_PLAN_FILE = "rank long, schema_name string, table_name string, index_name string, index_type string, size_bytes long, size_pretty string, scan_count long, last_scan string"


@query
def plan_json_file(spark, folder):
    rows = spark.read.schema(_PLAN_FILE + ", estimated_bloat_percent double").json(_plan_file(spark, folder, "json"))
    hundredths = F.floor(F.col("estimated_bloat_percent") * 100 + 0.5).cast("bigint")
    return rows.withColumn("bloat_hundredths", hundredths).drop("estimated_bloat_percent")


@query
def plan_csv_file(spark, folder):
    layout = _PLAN_FILE + ", estimated_bloat_percent decimal(20,2)"
    rows = spark.read.schema(layout).csv(_plan_file(spark, folder, "csv"), header=True, escape='"')
    hundredths = (F.col("estimated_bloat_percent") * 100).cast("bigint")
    return rows.withColumn("bloat_hundredths", hundredths).drop("estimated_bloat_percent")


@query
def plan_csv_text(spark, folder):
    rows = ranked_plan(_read_whole(spark, folder), None, "size", NOW)
    return plan_csv_lines(rows).select("rank", "line")


# --- scalars ---------------------------------------------------------------------------------------------------------


@query
def size_text(spark, folder):
    size = F.col("relsize")
    return bind_catalog(spark, folder, "class")["class"].select(
        "oid", size_gb_text(size).alias("size_gb"), size_pretty(size).alias("pretty"),
        size_pretty(F.shiftright(size, 20)).alias("pretty_small"), size_pretty(size * 4096).alias("pretty_large"),
    )


@query_as("last_scan_iso")
def scan_times(spark, folder):
    stats = bind_catalog(spark, folder, "stat_index")["stat_index"]
    scan = F.col("last_idx_scan")
    return stats.select("indexrelid", last_scan_iso(scan).alias("iso"), epoch_secs(scan).alias("epoch"), log_timestamp(scan).alias("log_time"))


@query
def event_times(spark, folder):
    events = bind(spark, folder, "events")["events"]
    return events.select(
        "event_id", last_scan_iso(F.col("ts")).alias("iso"), epoch_secs(F.col("ts")).alias("epoch"),
        log_timestamp(F.col("ts")).alias("log_time"),
    )


@query
def name_rules(spark, folder):
    views = bind(spark, folder, "part")
    name = F.concat(
        "p_name", F.element_at(F.array(*[F.lit(s) for s in ("", "_ccnew", "_ccnew7", "_ccnew_b_ccnew", "_CCNEW", "_ccnew1\n")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    )
    return views["part"].select("p_partkey", is_temp_rebuild_name(name).alias("is_temp"))


@query
def list_split(spark, folder):
    part = bind(spark, folder, "part")["part"]
    text = F.concat_ws(",", F.concat(F.lit(" "), "p_name", F.lit("\t ")), F.lit(" "), "p_brand", F.lit(""))
    return part.select("p_partkey", F.array_join(split_list(text), "|").alias("parts"))


@query
def csv_quoted(spark, folder):
    events = bind(spark, folder, "log_events")["log_events"]
    return events.select("message", csv_quote(F.col("message")).alias("quoted"), csv_quote(F.col("index_name")).alias("plain"))


@query
def commands(spark, folder):
    classes = bind_catalog(spark, folder, "class")["class"]
    name, kind = F.col("relname"), F.col("relkind")
    schema = F.col("relnamespace").cast("string")
    return classes.select(
        "oid",
        F.when(kind == "i", rebuild_command(schema, name)).otherwise(analyze_command(schema, name)).alias("command"),
        F.when(kind == "i", rebuild_command(schema, name, concurrently=False)).otherwise(analyze_command(schema, name, skip_locked=False)).alias("plain_command"),
    )


@query
def lsn_decode(spark, folder):
    samples = bind(spark, folder, "repl_samples")["repl_samples"]
    return samples.select(
        "instance_id", "ts", lsn_bytes(F.col("sent_lsn")).cast("bigint").alias("sent"),
        lsn_bytes(F.col("replay_lsn")).cast("bigint").alias("replay"),
    )


@query
def size_changes(spark, folder):
    views = bind(spark, folder, "cat_class", "after_snapshot")
    rows = views["cat_class"].join(views["after_snapshot"], "oid")
    change = size_change_pct(F.col("relsize"), F.col("after_size"))
    millionths = lambda c: F.floor(c.cast("double") * F.lit(1e6)).cast("bigint")
    return rows.select(
        "oid", millionths(change).alias("change"), millionths(change.cast("float")).alias("change_real"),
        millionths(round1(change)).alias("change_rounded"),
    )


@query
def error_classes(spark, folder):
    attempts = bind(spark, folder, "attempts")["attempts"]
    kind = classify_error(F.col("error"))
    return attempts.filter(F.col("error").isNotNull()).select(
        "index_oid", "attempt", kind["retryable"].alias("retryable"), kind["connection"].alias("connection"),
        kind["kind"].alias("kind"),
    )


# --- schedule --------------------------------------------------------------------------------------------------------


@query
def waves(spark, folder):
    rows = inventory.index_inventory(bind_catalog(spark, folder, *INDEXES), kind="all").select("schema_name", "table_name", "index_name", "size_bytes")
    return schedule.conflict_free_waves(rows, 8).select("schema_name", "table_name", "index_name", "wave", "lane")


@query
def waves_hot_tables(spark, folder):
    """The same with every table above 5 indexes treated as too big for one task."""
    rows = inventory.index_inventory(bind_catalog(spark, folder, *INDEXES), kind="all").select("schema_name", "table_name", "index_name", "size_bytes")
    rows = schedule.conflict_free_waves(rows, 8, hot_rows=5)
    return rows.select("schema_name", "table_name", "index_name", "wave", "lane")


@query
def worklist_commands(spark, folder):
    rows = inventory.index_inventory(bind_catalog(spark, folder, *INDEXES), ALL_SCHEMAS, kind="btree")
    return schedule.worklist_commands(rows.select("schema_ord", "schema_name", "index_name")).select("position", "total", "command")


# --- gates -----------------------------------------------------------------------------------------------------------


def _gates(spark, folder) -> DataFrame:
    views = bind(spark, folder, "activity", "slots", "repl_samples")
    return gates.preflight_gates(views["activity"], views["slots"], views["repl_samples"])


@query
def preflight(spark, folder):
    checked = _gates(spark, folder)
    strict = gates.preflight_reason(checked).withColumnRenamed("skip_reason", "strict_reason")
    return gates.preflight_reason(strict, skip_sync_replication=True)


@query
def active_vacuum(spark, folder):
    return gates.active_vacuum(bind(spark, folder, "activity")["activity"], own_pid=388)


@query
def inactive_slots(spark, folder):
    return gates.inactive_slots(bind(spark, folder, "slots")["slots"])


@query
def sync_standby(spark, folder):
    return gates.sync_standby(bind(spark, folder, "repl_samples")["repl_samples"])


@query
def bloat_gate(spark, folder):
    rows = inventory.page_drift(_read_once(spark, folder))
    return rows.select("schema_name", "index_name", gates.below_bloat_gate(4, F.col("bloat_percentage")).alias("below"))


@query
def settings_audit(spark, folder):
    return gates.settings_audit(bind(spark, folder, "settings")["settings"], 4, 2)


@query
def settings_audit_default_workers(spark, folder):
    return gates.settings_audit(bind(spark, folder, "settings")["settings"], 3, 0)


@query
def replica_lag(spark, folder):
    return gates.max_replica_lag(bind(spark, folder, "repl_samples")["repl_samples"])


@query_as("lag_throttle")
def lag_pauses(spark, folder):
    lags = gates.max_replica_lag(bind(spark, folder, "repl_samples")["repl_samples"])
    return lag_throttle(lags, MAX_LAG, WAIT_S)


@query_as("lag_throttle_default_wait")
def lag_pauses_default_wait(spark, folder):
    lags = gates.max_replica_lag(bind(spark, folder, "repl_samples")["repl_samples"])
    return lag_throttle(lags, 30_000_000)


@query_as("lag_series")
def lag_polls(spark, folder):
    return lag_series(bind(spark, folder, "repl_samples")["repl_samples"])


# --- state -----------------------------------------------------------------------------------------------------------


def _state(spark, folder) -> DataFrame:
    return bind(spark, folder, "state_prev")["state_prev"]


def _updates(spark, folder) -> DataFrame:
    return bind(spark, folder, "state_updates")["state_updates"]


@query
def state_merge(spark, folder):
    work = inventory.index_inventory(_read_once(spark, folder), kind="all")
    return state.state_merge(_state(spark, folder), work, SESSION, NOW)


@query
def state_merge_repeats(spark, folder):
    """A worklist that names an index in both passes."""
    cat = bind_catalog(spark, folder, *INDEXES, "inherits", stored=stored_pairs(spark, folder))
    work = inventory.inventory_union(cat, kind="all", include_partitions=True)
    return state.state_merge(_state(spark, folder), work, SESSION, NOW, order="pass")


@query
def state_apply(spark, folder):
    return state.apply_states(_state(spark, folder), _updates(spark, folder).drop("session_id"), NOW, order="seq")


@query
def state_claim(spark, folder):
    keys = _updates(spark, folder).filter(F.col("state") == "in_progress")
    return state.claim(_state(spark, folder), keys, SESSION, NOW)


@query
def state_reset(spark, folder):
    return state.reset_in_progress(_state(spark, folder), NOW)


@query
def state_reset_session(spark, folder):
    return state.reset_in_progress(_state(spark, folder), NOW, "s3")


@query
def state_reset_count(spark, folder):
    return state.reset_count(_state(spark, folder), "s3")


@query
def state_clear(spark, folder):
    return state.clear_schemas(_state(spark, folder), SCHEMAS)


@query
def state_pending(spark, folder):
    return state.load_pending(_state(spark, folder), SCHEMAS)


@query
def state_counts(spark, folder):
    return state.state_counts(_state(spark, folder), ["session_id"])


@query
def pending_flags(spark, folder):
    return state.pending_flags(_state(spark, folder), ["schema_name"])


@query
def state_final(spark, folder):
    return state.finalize_pending(_state(spark, folder))


@query
def completed_tables(spark, folder):
    return state.completed_tables(_state(spark, folder))


@query
def state_versions(spark, folder):
    """The state after two writes of the versioned table."""
    path = scratch_path(spark, "state")
    write_state(_state(spark, folder), path)
    write_state(state.reset_in_progress(read_state(spark, path), NOW), path)
    return read_state(spark, path)


@query_as("resume_worklist")
def resumed(spark, folder):
    """Fresh, resumed with open rows, resumed with none."""
    old = _state(spark, folder)
    found = inventory.index_inventory(bind_catalog(spark, folder, *INDEXES), kind="all")
    columns = ("schema_name", "table_name", "index_name", "index_type")
    cases = {
        "fresh": resume_worklist(old, found, False, SESSION, NOW, SCHEMAS),
        "open": resume_worklist(old, found, True, SESSION, NOW, SCHEMAS),
        "done": resume_worklist(old.filter(F.col("state").isin(*state.DONE)), found, True, SESSION, NOW, SCHEMAS),
    }
    parts = [case.worklist.select(F.lit(name).alias("scenario"), *columns) for name, case in cases.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def prepared_run(spark, folder):
    """State and schedule at the start of a fresh session with partitions."""
    run = prepare_run(
        bind_catalog(spark, folder, *INDEXES, "inherits"), _state(spark, folder), SCHEMAS, SESSION, NOW, min_gb=1, max_gb=8, kind="all",
        excluded=EXCLUDED, include_partitions=True, threads=4,
    )
    keys = ["schema_name", "index_name"]
    return run.worklist.select(*keys, "parent_table_name", "wave", "lane").join(
        run.state.select(*keys, "table_name", "state", "session_id"), keys, "full_outer"
    )


# --- outcomes and reports --------------------------------------------------------------------------------------------


@query
def attempt_fold(spark, folder):
    return outcome.fold_attempts(bind(spark, folder, "attempts")["attempts"])


def _run(spark, folder):
    # A run reads few of the catalog's rows: nothing of it is stored, so what it looks up is cut where the input is scanned.
    cat = bind_catalog(spark, folder, *INDEXES, "inherits", stored=())
    views = bind(spark, folder, "after_snapshot", "attempts", "state_prev", stored=())
    work = inventory.partition_indexes(cat).withColumn("instance_id", F.col("index_oid") % 20)
    checked = gates.preflight_reason(_gates(spark, folder), skip_sync_replication=True)
    after = views["after_snapshot"].withColumnRenamed("oid", "index_oid")
    return cat, work, after, checked, views


@query
def outcomes(spark, folder):
    cat, work, after, checked, views = _run(spark, folder)
    return run_outcomes(cat, work, after, checked, views["attempts"], 4, keys=()).drop("instance_id")


@query
def recorded_state(spark, folder):
    cat, work, after, checked, views = _run(spark, folder)
    order = F.regexp_extract("index_name", r"^part_(\d+)_idx$", 1).cast("bigint")
    old = views["state_prev"].withColumn("instance_id", order % 20)
    return record_run(cat, old, work, after, checked, views["attempts"], "all", NOW, 4, keys=()).state.drop("instance_id")


def _logbook(spark, folder) -> DataFrame:
    cat, work, after, checked, views = _run(spark, folder)
    # A logbook has no tables.
    rows = run_outcomes(cat, work.drop("table_name"), after, checked, views["attempts"], 4, keys=())
    day = F.lit(NOW).cast("timestamp") - F.make_interval(days=(F.col("index_oid") % 30).cast("int"))
    return outcome.logbook_rows(rows, "all", day).drop("instance_id")


@query
def logbook_report(spark, folder):
    return outcome.logbook_report(_logbook(spark, folder))


@query
def logbook_append(spark, folder):
    """Two appends to one table: the rows of a run, then its excluded indexes without a time of their own."""
    path = scratch_path(spark, "logbook")
    append_logbook(_logbook(spark, folder), path, NOW)
    named = inventory.named_catalog(bind_catalog(spark, folder, *INDEXES, stored=()), EXCLUDED)
    split = schedule.split_excluded(inventory.index_inventory(named, kind="all"), EXCLUDED, "all", NOW)
    append_logbook(split.logbook.drop("reindex_time"), path, NOW)
    return read_logbook(spark, path).drop("reindex_date")


@query
def logbook_rerun(spark, folder):
    """A run that is appended again after a failure has its rows once; another run adds its own."""
    path = scratch_path(spark, "logbook")
    rows = materialize(_logbook(spark, folder), "logbook-rows")
    append_logbook(rows.filter("reindex_status <> 'success'"), path, NOW, run_id="first")
    append_logbook(rows, path, NOW, run_id="first")
    append_logbook(rows.filter("reindex_status = 'failed'").drop("reindex_time"), path, NOW, run_id="second")
    return read_logbook(spark, path, with_run=True).groupBy("run_id", "schema_name", "reindex_status", "reindex_date").count()


@query
def state_in_place(spark, folder):
    """The current state changed by its writers, each of which rewrites only the parts of the keys it touches."""
    path = scratch_path(spark, "state-in-place")
    write_state(_state(spark, folder), path, parts=64)
    updates = materialize(_updates(spark, folder), "updates")
    update_state(spark, path, updates, lambda rows: state.apply_states(rows, updates, NOW, "seq"))
    taken = updates.filter("index_name LIKE '%7%'")
    update_state(spark, path, taken, lambda rows: state.claim(rows, taken, SESSION, NOW), "claim")
    update_state(spark, path, taken, lambda rows: rows.limit(0), "claim")
    return read_state(spark, path)


@query
def inventory_by_name(spark, folder):
    """Place of each index in an inventory ordered by schema position and name."""
    rows = inventory.index_inventory(bind_catalog(spark, folder, *INDEXES), ALL_SCHEMAS, kind="all")
    ordered = inventory.order_by_name(rows).select("schema_name", "index_name", F.monotonically_increasing_id().alias("_at"))
    return ranking.number_rows(ordered, ["_at"])[0].drop("_at")


@query
def analyze_targets(spark, folder):
    cat = bind_catalog(spark, folder, *INDEXES)
    names = bind(spark, folder, "analyze_names")["analyze_names"]
    relations = inventory.index_relations(cat)
    completed = relations.filter(F.col("index_type") != "gin").select("schema_name", "table_name")
    tables = relations.filter(F.col("table_pages") > 10).select("schema_name", "table_name")
    rows = outcome.analyze_targets(names, SCHEMAS, completed, tables)
    return rows.drop("schema_ord")


@query
def run_summary(spark, folder):
    return outcome.run_summary(_state(spark, folder), STARTED, ENDED, 4, ["session_id"])


# --- logs ------------------------------------------------------------------------------------------------------------


@query
def log_text_parse(spark, folder):
    path = scratch_path(spark, "log-text")
    to_log_text(bind(spark, folder, "log_events")["log_events"]).write.text(path)
    return read_log_text(spark, path).select("timestamp", "level", "message")


@query
def log_text_multiline(spark, folder):
    """Messages with line breaks, as servers write them, written as text and read back."""
    path = scratch_path(spark, "log-text")
    events = bind(spark, folder, "log_events")["log_events"]
    detail = F.concat("message", F.lit("\nDETAIL: [x] "), F.coalesce("index_name", F.lit("")), F.lit("\n\n  HINT: none"))
    to_log_text(events.withColumn("message", detail)).write.text(path)
    return read_log_text(spark, path).select("timestamp", "level", "message")


@query
def log_text_reject(spark, folder):
    """Lines of another form keep only their raw text."""
    lines = bind(spark, folder, "documents")["documents"].select(F.col("text").alias("value"))
    return parse_log_lines(lines).select("timestamp", "level", "message", F.length("raw").alias("n_chars"))


@query
def log_json_roundtrip(spark, folder):
    path = scratch_path(spark, "log-json")
    to_log_json(bind(spark, folder, "log_events")["log_events"]).write.text(path)
    columns = ("timestamp", "level", "message", "schema", "index_name", "status", "duration_secs", "current_index", "error")
    return read_log_json(spark, path).select(*columns)


@query
def log_report(spark, folder):
    return outcome.log_report(bind(spark, folder, "log_events")["log_events"])


@query
def failure_report(spark, folder):
    return outcome.failure_report(bind(spark, folder, "log_events")["log_events"])


@query
def outcome_log(spark, folder):
    cat, work, after, checked, views = _run(spark, folder)
    return outcome.outcome_events(run_outcomes(cat, work, after, checked, views["attempts"], 4, keys=()), NOW).drop("instance_id")


@query
def start_log(spark, folder):
    """Every index of a worklist as it is taken up, in list order, as JSON log lines read back."""
    path = scratch_path(spark, "start-log")
    rows = inventory.index_inventory(bind_catalog(spark, folder, *INDEXES), ALL_SCHEMAS, kind="btree")
    listed = schedule.worklist_commands(rows.select("schema_ord", "schema_name", "index_name", "index_type"))
    to_log_json(outcome.start_events(listed, STARTED)).write.text(path, compression="gzip")
    return read_log_json(spark, path).select("timestamp", "level", "message", "schema", "index_name", "index_type", "status", "current_index", "total_indexes")


@query
def summary_log(spark, folder):
    """Totals of each session as log events."""
    state_rows = bind(spark, folder, "state_prev")["state_prev"]
    events = outcome.summary_events(outcome.run_summary(state_rows, STARTED, ENDED, 4, ["session_id"]), ENDED)
    return events.select("timestamp", "level", "message", "status", "total_indexes", "failed_count")


@query
def log_reports_fleet(spark, folder):
    """Reports of a fleet: events and failures per instance."""
    events = bind(spark, folder, "log_events")["log_events"].withColumn("instance_id", (F.length("message") % 3).cast("bigint"))
    levels = outcome.log_report(events).select("instance_id", "level", "status", F.lit(None).cast("string").alias("index_name"), F.col("n_events").alias("n"))
    failed = outcome.failure_report(events).select("instance_id", F.lit(None).cast("string").alias("level"), F.lit("failures").alias("status"), "index_name", F.col("n_failures").alias("n"))
    return levels.unionByName(failed)


# --- sources ---------------------------------------------------------------------------------------------------------


@query
def catalog_load(spark, folder):
    """Catalog relations written as a snapshot of two instances and read back with fixed schemas."""
    path = scratch_path(spark, "catalog")
    for name, rows in bind_catalog(spark, folder, stored=("li_pair",)).items():
        both = rows.withColumn("instance_id", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))))
        both.select("instance_id", *CATALOG[name].names).write.parquet(f"{path}/{name}", compression="zstd")
    cat = load_catalog(spark, path, fleet=("instance_id",))
    return inventory.index_inventory(cat, kind="btree").select("instance_id", *inventory.INVENTORY_COLUMNS)


# --- streams ---------------------------------------------------------------------------------------------------------


def _drain(writer) -> None:
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()


def _sample_stream(spark, folder) -> DataFrame:
    """Replication samples as a stream over the events file."""
    from ..sources.bindings import VIEWS

    layout = spark.read.parquet(f"{folder}/events.parquet").schema
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.readStream.schema(layout).option("pathGlobFilter", "events.parquet").parquet(folder)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return spark.sql(VIEWS["repl_samples"], events=events)


def _stored(spark, stream: DataFrame, label: str) -> DataFrame:
    path = scratch_path(spark, label)
    _drain(stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-progress"))
    return spark.read.schema(stream.schema).parquet(path)


@query_as("lag_series_stream")
def lag_polls_stream(spark, folder):
    """Closed poll intervals only: the last ones stay open until later samples arrive."""
    return _stored(spark, lag_series(_sample_stream(spark, folder), watermark="1 minute"), "lag-polls")


def _throttle_stream(spark, folder, **arguments) -> DataFrame:
    """Samples that the watermark has passed, judged by the stateful stream."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _stored(spark, lag_throttle_stream(_sample_stream(spark, folder), MAX_LAG, WAIT_S, **arguments), "lag-throttle")
    finally:
        spark.conf.set(setting, before)


@query_as("lag_throttle_stream")
def throttle_stream(spark, folder):
    return _throttle_stream(spark, folder, poll=None)


@query_as("lag_throttle_polled_stream")
def throttle_polled_stream(spark, folder):
    return _throttle_stream(spark, folder, poll="10 minutes")


@query
def state_changelog_stream(spark, folder):
    """State updates read as a stream and folded into the versioned state."""
    path = scratch_path(spark, "state-stream")
    write_state(_state(spark, folder), path)
    source = scratch_path(spark, "state-updates")
    updates = _updates(spark, folder)
    updates.write.parquet(source)
    stream = spark.readStream.schema(updates.schema).parquet(source)
    _drain(state_from_changelog(stream, path, f"{path}-progress", lambda: NOW, order="seq"))
    return read_state(spark, path)
