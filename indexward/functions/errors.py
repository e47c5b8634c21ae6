"""Which failures of a rebuild are worth another attempt."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fragments of lower-cased server messages.
LOCK_TIMEOUT = "canceling statement due to lock timeout"
DEADLOCK = "deadlock detected"
CONNECTION = ("connection closed", "connection lost", "server closed the connection", "broken pipe", "connection reset")


def classify_error(message: Column) -> Column:
    """Struct ``(retryable, connection, kind)``; null for a null message, ``kind`` null when not retryable."""
    text = F.lower(message)
    blocked = text.contains(LOCK_TIMEOUT) | text.contains(DEADLOCK)
    dropped = reduce(lambda a, b: a | b, [text.contains(p) for p in CONNECTION])
    kind = (
        F.when(~blocked & dropped, F.lit("connection error"))
        .when(blocked & text.contains("deadlock"), F.lit("deadlock"))
        .when(blocked, F.lit("lock timeout"))
    )
    return F.when(
        message.isNotNull(),
        F.struct((blocked | dropped).alias("retryable"), (~blocked & dropped).alias("connection"), kind.alias("kind")),
    )
