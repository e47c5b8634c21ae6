"""The state table of maintenance runs. Every operator returns the new state; nothing is changed in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_timestamp
from ..keys import fleet_keys, index_keys, same_fleet, table_keys
from ..schemas import STATE_SCHEMA, STATES
from .filters import filter_schemas
from .latest import is_fixed, last_per_key

DONE = ("completed", "skipped")
OPEN = ("pending", "failed", "in_progress")


def _layout(state: DataFrame) -> list[str]:
    return [*fleet_keys(state), *STATE_SCHEMA.names]


def _last_per_index(rows: DataFrame, columns: Sequence[str], order: str, few: bool = False) -> DataFrame:
    """One row per index: the last by ``order``. Copies of one key are combined before the shuffle.

    ``few``: an index has few copies, so that one shuffle of the texts is less than to fetch them afterwards.
    """
    keys = index_keys(rows)
    if not few and is_fixed(rows, [order]):
        return last_per_key(rows, keys, columns, F.col(order))
    if few:  # as there, no row without a key or an order
        rows = rows.dropna(subset=[*keys, order])
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(order)).alias("last"))
    return last.select(*keys, *[F.col("last")[c].alias(c) for c in columns])


def state_merge(state: DataFrame, worklist: DataFrame, session: str, now, order: str | None = None) -> DataFrame:
    """Start a session: release what a crashed run left in progress, then upsert the worklist as pending.

    Finished indexes keep state and session. Rows that are not on the list stay.
    Table, type and update time of listed rows are refreshed. ``order`` names
    the list position when the worklist may hold an index twice.
    """
    listed = worklist.select(*index_keys(worklist), "table_name", "index_type", *([order] if order else []))
    if order:
        listed = _last_per_index(listed, ["table_name", "index_type"], order, few=True)
    same_fleet(state, listed)
    on = index_keys(state, listed)
    old, new = state.withColumn("_known", F.lit(True)).alias("old"), listed.withColumn("_listed", F.lit(True)).alias("new")
    rows = old.join(new, on, "full_outer")
    is_listed, is_new = F.col("_listed").isNotNull(), F.col("_known").isNull()
    stuck, done = F.col("old.state") == "in_progress", F.col("old.state").isin(*DONE)
    moment = as_timestamp(now)
    return rows.select(
        *on,
        F.coalesce("new.table_name", "old.table_name").alias("table_name"),
        F.coalesce("new.index_type", "old.index_type").alias("index_type"),
        F.when(is_new | (is_listed & ~done) | stuck, F.lit("pending")).otherwise(F.col("old.state")).alias("state"),
        F.when(is_new | (is_listed & ~done), F.lit(session)).when(~stuck, F.col("old.session_id")).alias("session_id"),
        F.when(is_new, moment).otherwise(F.col("old.created_at")).alias("created_at"),
        F.when(is_listed, moment).otherwise(F.col("old.updated_at")).alias("updated_at"),
    ).select(*_layout(state))


def apply_states(state: DataFrame, updates: DataFrame, now, order: str | None = None) -> DataFrame:
    """Set the state of known indexes; updates for unknown ones are ignored.

    With ``order``, the last of several updates of one index counts. Updates may
    carry their own ``updated_at``, and a ``session_id`` that claims the index
    when its new state is in progress.
    """
    carried = [c for c in ("state", "updated_at", "session_id") if c in updates.columns]
    latest = _last_per_index(updates, carried, order) if order else updates.select(*index_keys(updates), *carried)
    same_fleet(state, latest)
    on = index_keys(state, latest)
    rows = state.join(latest.withColumnsRenamed({c: f"_{c}" for c in carried}), on, "left")
    hit = F.col("_state").isNotNull()
    moment = F.coalesce("_updated_at", as_timestamp(now)) if "updated_at" in carried else as_timestamp(now)
    claimed = F.col("_state") == "in_progress"
    session = F.when(claimed, F.col("_session_id")).otherwise(F.col("session_id")) if "session_id" in carried else F.col("session_id")
    return rows.withColumns({
        "state": F.coalesce("_state", "state"),
        "updated_at": F.when(hit, moment).otherwise(F.col("updated_at")),
        "session_id": session,
    }).select(*_layout(state))


def claim(state: DataFrame, keys: DataFrame, session: str, now) -> DataFrame:
    """Mark indexes as in progress for a session."""
    same_fleet(state, keys)
    on = index_keys(state, keys)
    rows = state.join(keys.select(*on).distinct().withColumn("_claimed", F.lit(True)), on, "left")
    hit = F.col("_claimed").isNotNull()
    return (
        rows.withColumn("state", F.when(hit, F.lit("in_progress")).otherwise(F.col("state")))
        .withColumn("session_id", F.when(hit, F.lit(session)).otherwise(F.col("session_id")))
        .withColumn("updated_at", F.when(hit, as_timestamp(now)).otherwise(F.col("updated_at")))
        .select(*_layout(state))
    )


def is_stuck(session: str | None = None) -> Column:
    """Condition: in progress, optionally for one session."""
    stuck = F.col("state") == "in_progress"
    return stuck if session is None else stuck & F.coalesce(F.col("session_id") == session, F.lit(False))


def reset_in_progress(state: DataFrame, now, session: str | None = None) -> DataFrame:
    """Put interrupted indexes back to pending. The session stays; the update time is set."""
    hit = is_stuck(session)
    return state.withColumn("updated_at", F.when(hit, as_timestamp(now)).otherwise(F.col("updated_at"))).withColumn(
        "state", F.when(hit, F.lit("pending")).otherwise(F.col("state"))
    )


def reset_count(state: DataFrame, session: str | None = None) -> DataFrame:
    """How many rows ``reset_in_progress`` changes."""
    return state.groupBy(*fleet_keys(state)).agg(F.count_if(is_stuck(session)).alias("reset_count"))


def clear_schemas(state: DataFrame, schemas: Sequence[str] | DataFrame) -> DataFrame:
    """Forget the listed schemas."""
    if isinstance(schemas, DataFrame):
        return state.join(schemas, [*fleet_keys(state, schemas), "schema_name"], "left_anti").select(*state.columns)
    return state.filter(~F.col("schema_name").isin(list(schemas)))


def load_pending(state: DataFrame, schemas: Sequence[str] | DataFrame | None = None, table: str | None = None) -> DataFrame:
    """Worklist of what is not finished, whatever its state says. Size and parent are not stored."""
    rows = state.filter(~F.col("state").isin(*DONE))
    if schemas is not None:
        rows = filter_schemas(rows, schemas)
    if table is not None:
        rows = rows.filter(F.col("table_name") == table)
    return rows.select(
        *fleet_keys(rows), "schema_name", "table_name", "index_name", "index_type",
        F.lit(None).cast("bigint").alias("size_bytes"), F.lit(None).cast("string").alias("parent_table_name"),
    )


def state_counts(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The five counters in one pass."""
    return state.groupBy(*by).agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES])


def pending_flags(state: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Per session: is anything left to do."""
    open_rows = F.count_if(F.col("state").isin(*OPEN))
    return state.groupBy(*by).agg((open_rows > 0).alias("has_pending"), open_rows.alias("open_count"))


def has_pending(state: DataFrame, session: str | None = None) -> bool:
    """Is anything left to do, over all schemas. Stops at the first hit."""
    rows = state.filter(F.col("state").isin(*OPEN))
    return not (rows if session is None else rows.filter(F.col("session_id") == session)).isEmpty()


def completed_tables(state: DataFrame) -> DataFrame:
    """Tables with at least one rebuilt index."""
    return state.filter(F.col("state") == "completed").select(*table_keys(state)).distinct()


def outcome_to_state(outcome: Column) -> Column:
    """State that follows from an outcome; anything unexpected is a failure."""
    return (
        F.when(outcome == "success", F.lit("completed"))
        .when(outcome.isin("skipped", "invalid_index", "below_bloat_threshold"), F.lit("skipped"))
        .otherwise(F.lit("failed"))
    )


def finalize_pending(state: DataFrame) -> DataFrame:
    """At the end of a run what was never started counts as skipped."""
    return state.withColumn("state", F.when(F.col("state") == "pending", F.lit("skipped")).otherwise(F.col("state")))
