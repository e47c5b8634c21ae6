"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]

#: Documents that one step of a Python task holds as Python objects.
ROWS_AT_ONCE = 512


#: Up to so many rows, keys of rows are broadcast (some 50 MB); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def broadcast_checked(rows: DataFrame) -> DataFrame:
    """A stored table of keys, marked for broadcast if its number of rows allows it."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


_owner: tuple[str, Callable[[], object]] | None = None


def remembers(owner: str, forget: Callable[[], object] = lambda: None) -> None:
    """Say at the start of a task that this Python process works for ``owner``, whose memories ``forget`` drops.

    Spark reuses its Python processes for later stages. What another operator has remembered in this one is dropped, so that
    memories of several operators do not add up.
    """
    global _owner
    if _owner is not None and _owner[0] != owner:
        _owner[1]()
        _give_back()
    _owner = (owner, forget)


def _give_back() -> None:
    """Return freed memory to the system, which Arrow and the C library otherwise keep for this process alone."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_task_each(df: DataFrame, column: str) -> DataFrame:
    """Rows that name large things to read (files), dealt to all shuffle partitions although the rows are small.

    By a hash of the column: rows that are already partitioned by the column itself would stay where they are, and few rows
    are then merged into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(column))


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of an id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(parts)


def in_fold(doc_id: str, parts: int, at: int) -> Column:
    """Whether an id is in fold ``at``; a null id is in none."""
    return F.coalesce(fold(doc_id, parts) == at, F.lit(False))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are.

    A text of single bytes only is ASCII, for which ``lower`` is the same and much faster.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def slices(batches: Batches, rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_texts(
    docs: DataFrame, keep: dict[str, str], text: str, schema: str, make: Callable[[], Callable[[list[str]], dict[str, list]]],
) -> DataFrame:
    """One output row per document: the columns ``keep`` (name: source) and what a Python function makes of the texts.

    ``make`` runs once per task and returns the function from a list of texts (null: empty) to output columns. ``schema``
    describes these output columns.
    """
    picked = docs.select(*[F.col(source).alias(name) for name, source in keep.items()], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    full = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]), schema])

    def run(batches: Batches) -> Batches:
        work = make()
        for batch in slices(batches):
            out = work(batch.column("_text").to_pylist())
            columns = [batch.column(name) for name in keep] + [pa.array(v) if isinstance(v, list) else v for v in out.values()]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *out])

    return picked.mapInArrow(run, full)
