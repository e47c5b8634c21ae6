"""State changes as a stream, folded into the state table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.state import apply_states
from ..sources.tables import update_state


def fold_changes(path: str, now: Callable, order: str, name: str = "changelog") -> Callable[[DataFrame, int], None]:
    """Batch writer: apply a micro-batch of updates to the parts of the state in which its indexes lie.

    Each change names the batch it came from, so a batch that is delivered again after a failure is skipped.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        update_state(batch.sparkSession, path, batch, lambda rows: apply_states(rows, batch, now(), order), f"{name}:{batch_id}")

    return fold


def state_from_changelog(
    updates: DataFrame, path: str, checkpoint: str, now: Callable, order: str = "updated_at", name: str = "changelog"
):
    """Stream writer for updates ``(schema_name, index_name, state[, session_id], updated_at)``; start it as usual."""
    return updates.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fold_changes(path, now, order, name))
