"""What a run did: attempts, outcomes, reports and follow-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import as_timestamp, classify_error, parse_index_kind, round1, size_change_pct, validate_schemas
from ..keys import fleet_keys, same_fleet, table_keys
from ..schemas import LAST_ATTEMPT, LOGBOOK_SCHEMA
from .gates import below_bloat_gate
from .state import finalize_pending, outcome_to_state, state_counts

INDEX_ID = "index_oid"

# What outcomes take over from a worklist; where it has no tables, neither have they.
NAMES = ("schema_name", "table_name", "index_name")

# Status of an index that nothing has stopped before its first attempt.
LET_THROUGH = "_let_through"

# Texts of log messages.
SUMMARY_TEXT = "Reindexing completed: %d total indexes processed, %d failed, Duration: %s (using %d threads)"
SUCCESS_TEXT = "Reindexed %s successfully"
FAILED_TEXT = "%s - Reindex failed"
START_TEXT = "[%d/%d] Starting reindex: %s.%s (%s)"
SESSION_TEXT = (
    "Session parameters: maintenance_work_mem=%dGB, max_parallel_maintenance_workers=%d, maintenance_io_concurrency=%d, lock_timeout=%ds"
)
SIZE_LIMITS_TEXT = "Index size limits: minimum %d GB, maximum %d GB"
INTEGRITY_TEXT = "Index integrity check failed after reindexing"


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def fold_attempts(attempts: DataFrame, with_error: bool = True) -> DataFrame:
    """One row per index: attempts up to the first success, the first final error or the last allowed one.

    ``outcome`` is ``ok``, ``failed``, or ``incomplete`` when the attempts stop
    before any of these. The duration runs from the start of the first to the
    end of the last attempt, waits included. A hash aggregate of numbers, combined
    before the shuffle; the text of the error is fetched for failed indexes only.
    """
    keys = [*fleet_keys(attempts), INDEX_ID]
    final = F.col("error").isNull() | ~classify_error(F.col("error"))["retryable"] | (F.col("attempt") >= LAST_ATTEMPT)
    rows = attempts.withColumns({
        "_number": F.when(final, F.col("attempt")), "_began": _seconds(F.col("started_at")), "_error": F.xxhash64("error"),
    })
    rows = rows.withColumn("_ended", F.col("_began") + F.col("duration_s"))
    folded = rows.groupBy(*keys).agg(
        F.min("_number").alias("number"), F.min_by(F.col("error").isNull(), "_number").alias("fine"), F.min_by("_error", "_number").alias("_error"),
        F.min_by("_ended", "_number").alias("ended"), F.min_by("_began", "attempt").alias("began"), F.max("attempt").alias("seen"),
    )
    outcome = F.when(F.col("number").isNull(), F.lit("incomplete")).when(F.col("fine"), F.lit("ok")).otherwise(F.lit("failed"))
    folded = folded.withColumn("outcome", outcome)
    error = []
    if with_error:
        texts = rows.filter("error IS NOT NULL").select(*keys, F.col("_number").alias("number"), "_error", "error").distinct()
        # Only failures have a text to look for: for the others the number of the last attempt is left open.
        wanted = folded.withColumns({"ends": F.col("number"), "number": F.when(F.col("outcome") == "failed", F.col("number"))})
        folded = wanted.join(texts, [*keys, "number", "_error"], "left").withColumn("number", F.col("ends"))
        error = ["error"]
    return folded.select(
        *keys, "outcome", (F.coalesce("number", "seen") + 1).cast("int").alias("attempts_used"), *error,
        (F.col("ended") - F.col("began")).alias("duration_secs"),
    )


def gated_outcomes(
    worklist: DataFrame, before: DataFrame, after: DataFrame, gates: DataFrame, bloat_threshold: int | None = None,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """What is known of every index on the worklist without its attempts; see ``outcome_records``.

    ``_status`` has what is decided, null where the size before could not be read, and ``LET_THROUGH`` where the attempts
    decide. Only these rows keep what was measured.
    """
    rows = worklist
    for part in (before, after):
        lead = same_fleet(worklist, part) if keys is None else list(keys)
        rows = rows.join(part.drop(*[k for k in fleet_keys(part) if k not in lead]), [*lead, INDEX_ID], "left")
    on = fleet_keys(rows, gates)
    gates = gates.select(*on, "skip_reason")
    rows = rows.join(gates, on, "left") if on else rows.withColumn("skip_reason", gates.select("skip_reason").scalar())
    status = (
        F.when(F.col("before_size").isNull(), F.lit(None))
        .when(~F.coalesce("healthy_before", F.lit(False)), F.lit("invalid_index"))
        .when(below_bloat_gate(bloat_threshold, F.col("bloat_percentage")), F.lit("below_bloat_threshold"))
        .when(F.col("skip_reason").isNotNull(), F.lit("skipped"))
        .otherwise(F.lit(LET_THROUGH))
    )
    rows = rows.withColumn("_status", status)
    names = [c for c in NAMES if c in worklist.columns]
    measured = [F.when(F.col("_status") == LET_THROUGH, F.col(c)).alias(c) for c in ("before_size", "after_size", "healthy_after")]
    return rows.select(*fleet_keys(rows), INDEX_ID, *names, "_status", *measured)


def attempted_outcomes(rows: DataFrame, folded: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Outcomes from ``gated_outcomes`` and the folded attempts of those let through; others may be left out."""
    folded = folded.withColumnRenamed("outcome", "attempt_outcome").drop("attempts_used")
    lead = same_fleet(rows, folded) if keys is None else list(keys)
    rows = rows.join(folded.drop(*[k for k in fleet_keys(folded) if k not in lead]), [*lead, INDEX_ID], "left")
    status = (
        F.when(~F.coalesce(F.col("_status") == LET_THROUGH, F.lit(False)), F.col("_status"))
        .when(F.col("attempt_outcome").isNull() | (F.col("attempt_outcome") == "incomplete"), F.lit("_running"))
        .when(F.col("attempt_outcome") == "failed", F.lit("failed"))
        .when(F.col("after_size").isNull(), F.lit(None))
        .when(~F.coalesce("healthy_after", F.lit(False)), F.lit("validation_failed"))
        .otherwise(F.lit("success"))
    )
    rows = rows.withColumn("_status", status)
    running = F.coalesce(F.col("_status") == "_running", F.lit(False))
    measured = F.col("_status").isin("failed", "validation_failed", "success")
    finished = F.col("_status").isin("validation_failed", "success")
    change = size_change_pct(F.col("before_size"), F.col("after_size"))
    return rows.select(
        *fleet_keys(rows), INDEX_ID, *[c for c in NAMES if c in rows.columns],
        F.when(~running, F.col("_status")).alias("reindex_status"),
        F.when(~running, outcome_to_state(F.coalesce("_status", F.lit("failed")))).alias("state"),
        F.when(measured, F.col("before_size")).alias("before_size"),
        F.when(finished, F.col("after_size")).alias("after_size"),
        F.when(F.col("_status") == "success", change.cast("float")).when(finished, round1(change)).alias("size_change"),
        F.when(measured, round1(F.col("duration_secs"))).alias("reindex_duration"),
    )


def outcome_records(
    worklist: DataFrame, before: DataFrame, after: DataFrame, gates: DataFrame, attempts: DataFrame,
    bloat_threshold: int | None = None, keys: Sequence[str] | None = None,
) -> DataFrame:
    """Decide the outcome of every index on the worklist; the first rule that matches wins.

    ``before`` (size, health, gate bloat), ``after`` (size, health) and
    ``attempts`` are keyed by index id, ``gates`` (with ``skip_reason``) by
    instance. Where a size could not be read the state is failed and
    ``reindex_status`` null: such an index has no logbook row. An index whose
    attempts are not over has neither status nor state.

    An index id is unique in one database only. So ``before``, ``after`` and
    ``attempts`` must have the leading keys of the worklist, unless ``keys`` names
    those that tell the ids apart (none: the ids are unique by themselves).
    """
    rows = gated_outcomes(worklist, before, after, gates, bloat_threshold, keys)
    return attempted_outcomes(rows, fold_attempts(attempts, with_error=False), keys)


def logbook_rows(outcomes: DataFrame, kind: str, now) -> DataFrame:
    """Outcomes as logbook rows. The index type is the name of the kind filter of the run."""
    named = outcomes.filter(F.col("reindex_status").isNotNull()).withColumn("index_type", F.lit(parse_index_kind(kind)))
    return named.withColumn("reindex_time", as_timestamp(now)).select(*fleet_keys(outcomes), *LOGBOOK_SCHEMA.names)


def outcome_states(outcomes: DataFrame) -> DataFrame:
    """Outcomes as state updates."""
    return outcomes.filter(F.col("state").isNotNull()).select(*fleet_keys(outcomes), "schema_name", "index_name", "state")


def logbook_report(logbook: DataFrame) -> DataFrame:
    """Per schema, day and status: rows, bytes before and after, bytes reclaimed, mean duration.

    Durations are summed in whole tenths of a second, so the mean does not depend on row order.
    """
    tenths = F.sum(F.round(F.col("reindex_duration") * F.lit(10.0)).cast("bigint"))
    return logbook.groupBy(
        *fleet_keys(logbook), "schema_name", F.to_date("reindex_time").alias("reindex_date"), "reindex_status"
    ).agg(
        F.count(F.lit(1)).alias("n_indexes"),
        F.sum("before_size").alias("bytes_before"),
        F.sum("after_size").alias("bytes_after"),
        F.sum(F.col("before_size") - F.col("after_size")).alias("bytes_reclaimed"),
        (tenths / F.count("reindex_duration") / F.lit(10.0)).alias("mean_duration"),
    )


def resolve_analyze_targets(names: DataFrame, schemas: Sequence[str]) -> DataFrame:
    """Named tables as ``(schema_name, table_name)`` with their list position; repeats stay.

    ``names`` has ``target`` and ``target_ord``. A name with a dot is split at
    the first one and dropped when a part is empty; a plain name stands for that
    table in each of the listed schemas (at most 512).
    """
    listed = F.array(*[F.lit(s) for s in validate_schemas(schemas)])
    position = F.instr(F.col("target"), ".")
    dotted = position > 0
    head = F.trim(F.substring_index("target", ".", 1))
    tail = F.trim(F.substr(F.col("target"), position + 1))
    exploded = names.withColumn("_dotted", dotted).select(
        *fleet_keys(names), "target_ord", "_dotted",
        F.when(dotted, tail).otherwise(F.trim("target")).alias("table_name"),
        F.posexplode(F.when(dotted, F.array(head)).otherwise(listed)).alias("schema_ord", "schema_name"),
    )
    return exploded.filter((F.col("schema_name") != "") & (F.col("table_name") != "")).drop("_dotted")


def analyze_targets(names: DataFrame, schemas: Sequence[str], completed: DataFrame, tables: DataFrame) -> DataFrame:
    """Targets with ``action``: ``not_reindexed``, ``missing`` or ``run``.

    ``completed`` and ``tables`` hold distinct (schema, table) rows.
    """
    rows = resolve_analyze_targets(names, schemas)
    for part, flag in ((completed, "_completed"), (tables, "_exists")):
        on = table_keys(rows, part)
        rows = rows.join(part.select(*on).distinct().withColumn(flag, F.lit(True)), on, "left")
    action = (
        F.when(F.col("_completed").isNull(), F.lit("not_reindexed"))
        .when(F.col("_exists").isNull(), F.lit("missing"))
        .otherwise(F.lit("run"))
    )
    return rows.withColumn("action", action).drop("_completed", "_exists")


def run_summary(entries: DataFrame, started_at, ended_at, threads: int, by: Sequence[str] = ()) -> DataFrame:
    """Totals of a finished run; indexes that were never started count as skipped."""
    counts = state_counts(finalize_pending(entries), by)
    total = sum((F.col(s) for s in ("pending", "in_progress", "completed", "failed")), F.col("skipped"))
    duration = (F.unix_micros(as_timestamp(ended_at)) - F.unix_micros(as_timestamp(started_at))) / F.lit(1e6)
    return counts.select(
        *by, total.alias("total_indexes"), F.col("failed").alias("failed_count"), "completed", "skipped",
        duration.alias("duration_secs"), F.lit(threads).alias("thread_count"),
    )


def summary_events(summary: DataFrame, ended_at) -> DataFrame:
    """Run summaries as log events."""
    seconds = F.col("duration_secs")
    text = F.when(seconds >= 1, F.format_string("%.2fs", seconds)).otherwise(F.format_string("%.2fms", seconds * 1000))
    message = F.format_string(SUMMARY_TEXT, F.col("total_indexes"), F.col("failed_count"), text, F.col("thread_count"))
    return summary.select(
        as_timestamp(ended_at).alias("timestamp"), F.lit("SUCCESS").alias("level"), message.alias("message"),
        F.lit("completed").alias("status"), "duration_secs", "total_indexes", "failed_count", "thread_count",
    )


def start_events(listed: DataFrame, now) -> DataFrame:
    """One event per index of a numbered worklist (``position``, ``total``) that is taken up."""
    parts = ("position", "total", "schema_name", "index_name", "index_type")
    return listed.select(
        *fleet_keys(listed), as_timestamp(now).alias("timestamp"), F.lit("INFO").alias("level"),
        F.format_string(START_TEXT, *[F.col(c) for c in parts]).alias("message"), F.col("schema_name").alias("schema"), "index_name", "index_type",
        F.lit("starting").alias("status"), F.col("position").alias("current_index"), F.col("total").alias("total_indexes"),
    )


def setup_events(spark: SparkSession, now, work_mem_gb: int, workers: int, io_concurrency: int, lock_timeout_s: int, min_gb: int, max_gb: int) -> DataFrame:
    """The two events at the start of a session: its parameters and the size limits of the worklist."""
    at = [as_timestamp(now).alias("timestamp"), F.lit("INFO").alias("level")]
    session = {
        "maintenance_work_mem_gb": work_mem_gb, "max_parallel_maintenance_workers": workers, "maintenance_io_concurrency": io_concurrency,
        "lock_timeout_seconds": lock_timeout_s,
    }
    limits = {"min_size_gb": min_gb, "max_size_gb": max_gb}

    def event(text: str, values: dict[str, int]) -> DataFrame:
        columns = [F.lit(v).cast("bigint").alias(k) for k, v in values.items()]
        return spark.range(1).select(*at, F.format_string(text, *columns).alias("message"), *columns)

    return event(SESSION_TEXT, session).unionByName(event(SIZE_LIMITS_TEXT, limits), allowMissingColumns=True)


def outcome_events(outcomes: DataFrame, now) -> DataFrame:
    """Rebuilds that were carried out, as log events."""
    name = F.concat_ws(".", "schema_name", "index_name")
    status = F.col("reindex_status")
    message = (
        F.when(status == "success", F.format_string(SUCCESS_TEXT, name))
        .when(status == "validation_failed", F.concat(name, F.lit(" - " + INTEGRITY_TEXT)))
        .otherwise(F.format_string(FAILED_TEXT, name))
    )
    rows = outcomes.filter(status.isin("success", "validation_failed", "failed"))
    return rows.select(
        *fleet_keys(rows), as_timestamp(now).alias("timestamp"),
        F.when(status == "success", F.lit("SUCCESS")).otherwise(F.lit("ERROR")).alias("level"),
        message.alias("message"), F.col("schema_name").alias("schema"), "index_name", status.alias("status"),
        F.when(status == "validation_failed", F.lit(INTEGRITY_TEXT)).alias("error"),
    )


def log_report(events: DataFrame) -> DataFrame:
    """Number of events per level and status, per instance and database where events name them."""
    return events.groupBy(*fleet_keys(events), "level", "status").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at")
    )


def failure_report(events: DataFrame) -> DataFrame:
    """Per index (of an instance and database where events name them): how often its rebuild failed, and the latest reason."""
    failed = events.filter(F.col("status").isin("failed", "validation_failed"))
    return failed.groupBy(*fleet_keys(events), "schema", "index_name").agg(
        F.count(F.lit(1)).alias("n_failures"),
        F.max_by("error", F.struct("timestamp", "error")).alias("last_error"),
        F.max("timestamp").alias("last_failed_at"),
    )
