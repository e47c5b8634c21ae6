"""A maintenance run: what to do before it (worklist, state, schedule) and after it (outcomes, state, logbook)."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..keys import fleet_keys, same_fleet
from ..operators.inventory import Catalog, before_snapshot, dedupe_last_wins, inventory_union, within_ids
from ..operators.outcome import (
    INDEX_ID, LET_THROUGH, NAMES, attempted_outcomes, fold_attempts, gated_outcomes, logbook_rows, outcome_states,
)
from ..operators.schedule import conflict_free_waves, split_excluded
from ..operators.state import OPEN, apply_states, clear_schemas, has_pending, load_pending, state_merge
from ..sources.scratch import materialize

# Attempts of up to this many indexes are found by a broadcast of their ids: some 20 MB.
MAX_BROADCAST_IDS = 500_000


class Resumed(NamedTuple):
    """State and worklist a session starts with."""

    state: DataFrame
    worklist: DataFrame


class Prepared(NamedTuple):
    """State, excluded rows for the logbook, and the worklist with waves and lanes."""

    state: DataFrame
    excluded: DataFrame
    worklist: DataFrame


class Recorded(NamedTuple):
    """State, logbook rows and all outcomes of a run."""

    state: DataFrame
    logbook: DataFrame
    outcomes: DataFrame


def resume_worklist(
    state: DataFrame, inventory: DataFrame, resume: bool, session: str, now, schemas: Sequence[str] | DataFrame,
    table: str | None = None,
) -> Resumed:
    """Where a session starts.

    Fresh: the schemas are forgotten and the inventory is the list. Resumed with
    anything open (in any schema): the open rows are the list and nothing is
    discovered. Resumed with nothing open: the inventory is merged first. In a
    fleet each instance and database decides by itself.
    """
    if not resume:
        return Resumed(clear_schemas(state, schemas), inventory)
    lead = same_fleet(state, inventory)
    if lead:
        busy = state.filter(F.col("state").isin(*OPEN)).select(*lead).distinct()
        idle = state_merge(state.join(busy, lead, "left_anti"), inventory.join(busy, lead, "left_anti"), session, now)
        state = idle.unionByName(state.join(busy, lead, "left_semi").select(*idle.columns))
    elif not has_pending(state):
        state = state_merge(state, inventory, session, now)
    return Resumed(state, load_pending(state, schemas, table))


def prepare_run(
    cat: Catalog, state: DataFrame, schemas: Sequence[str], session: str, now, resume: bool = False,
    table: str | None = None, min_gb: int = 0, max_gb: int | None = None, kind: str = "btree", excluded: Sequence[str] = (),
    include_partitions: bool = False, threads: int = 2,
) -> Prepared:
    """From catalog and previous state to the schedule of a session.

    The list is written once: exclusion, state and schedule each read it. An
    excluded index that a fresh run lists is not in the new state at all.
    """
    found = inventory_union(cat, schemas, table, min_gb, max_gb, kind, include_partitions)
    distinct = dedupe_last_wins(found) if include_partitions else found
    start = resume_worklist(state, distinct, resume, session, now, schemas, table)
    listed = materialize(start.worklist if resume else found, "worklist")
    split = split_excluded(listed, excluded, kind, now)
    work = split.worklist
    if include_partitions and not resume:
        work = materialize(dedupe_last_wins(work), "distinct-worklist")
    marked = apply_states(start.state, split.state_updates.distinct(), now)
    if not resume:
        marked = state_merge(marked, work, session, now)
    return Prepared(marked, split.logbook, conflict_free_waves(work, threads, table is not None, stored=True))


def _folded_attempts(rows: DataFrame, attempts: DataFrame, keys: Sequence[str] | None) -> DataFrame:
    """Folded attempts of the indexes that were let through; the others are decided without theirs.

    Few ids are broadcast and reduce the attempts before any shuffle. Attempts with leading keys by which they are not
    looked up are kept for all rows.
    """
    if keys is not None and fleet_keys(attempts) != list(keys):
        return fold_attempts(within_ids(attempts, INDEX_ID, rows, INDEX_ID), with_error=False)
    on = [*fleet_keys(attempts), INDEX_ID]
    waiting = rows.filter(F.col("_status") == LET_THROUGH).select(*on)
    attempts = within_ids(attempts, INDEX_ID, waiting, INDEX_ID)
    if waiting.count() > MAX_BROADCAST_IDS:
        return fold_attempts(attempts, with_error=False)
    return F.broadcast(fold_attempts(attempts.join(F.broadcast(waiting), on, "left_semi"), with_error=False))


def run_outcomes(
    cat: Catalog, worklist: DataFrame, after: DataFrame, gates: DataFrame, attempts: DataFrame, bloat_threshold: int | None = None,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Outcome of every index on the worklist, which is written once, with what outcomes take from it: its indexes are looked up
    in several relations. What the gates decide is written before the attempts are looked up, for the others only.
    """
    if keys is None:
        same_fleet(worklist, attempts)
    worklist = worklist.select(*fleet_keys(worklist), INDEX_ID, *[c for c in NAMES if c in worklist.columns])
    worklist = materialize(worklist, "worklist")
    after = within_ids(after, INDEX_ID, worklist, INDEX_ID)
    rows = gated_outcomes(worklist, before_snapshot(cat, worklist, exact=False), after, gates, bloat_threshold, keys)
    rows = materialize(rows, "gated-outcomes")
    return attempted_outcomes(rows, _folded_attempts(rows, attempts, keys), keys)


def record_run(
    cat: Catalog, state: DataFrame, worklist: DataFrame, after: DataFrame, gates: DataFrame, attempts: DataFrame, kind: str,
    now, bloat_threshold: int | None = None, keys: Sequence[str] | None = None,
) -> Recorded:
    """From what was observed during a session to its outcomes, logbook rows and new state."""
    outcomes = materialize(run_outcomes(cat, worklist, after, gates, attempts, bloat_threshold, keys), "outcomes")
    return Recorded(
        apply_states(state, outcome_states(outcomes), now), logbook_rows(outcomes, kind, now), outcomes
    )
