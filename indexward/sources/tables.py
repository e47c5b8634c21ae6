"""The two persisted tables: an append-only logbook and a versioned state table."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.times import as_timestamp
from ..keys import fleet_keys, index_keys, same_fleet
from ..schemas import LOGBOOK_SCHEMA, STATE_SCHEMA, empty_logbook, empty_state
from .catalog import is_missing_path
from .scratch import hadoop_path


def append_logbook(rows: DataFrame, path: str, now, run_id: str | None = None) -> None:
    """Append outcome rows, one folder per run and day. ``reindex_time`` defaults to ``now``.

    The rows of a run replace what the same ``run_id`` has written before, so a job that is run again after a failure does not
    append twice. Without ``run_id`` every call is a run of its own. The rebalance keeps files of even size: small days are
    merged, a big day is split.
    """
    run = run_id if run_id is not None else uuid.uuid4().hex
    if not re.fullmatch(r"[A-Za-z0-9._-]+", run):
        raise ValueError(f"a run id has letters, digits, '.', '_' and '-' only, not '{run}'")
    stamp = F.coalesce(F.col("reindex_time"), as_timestamp(now)) if "reindex_time" in rows.columns else as_timestamp(now)
    names = [*fleet_keys(rows), *LOGBOOK_SCHEMA.names]
    full = rows.withColumn("reindex_time", stamp).select(*names).withColumn("reindex_date", F.to_date("reindex_time"))
    # The prefix keeps ids of digits from being read as numbers.
    full.hint("rebalance", "reindex_date").write.mode("overwrite").partitionBy("reindex_date").parquet(f"{path}/run_id=run-{run}")


def read_logbook(spark: SparkSession, path: str, with_run: bool = False) -> DataFrame:
    """The logbook; empty when nothing was written yet. ``with_run`` adds ``run_id``."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as error:
        if not is_missing_path(error):
            raise
        rows = empty_logbook(spark)
    if not with_run:
        return rows.drop("run_id")
    return rows.withColumn("run_id", F.regexp_replace("run_id", "^run-", "") if "run_id" in rows.columns else F.lit(None).cast("string"))


#: Parts of a new state table, unless ``write_state`` is told another number.
STATE_PARTS = 32
#: The log of versions is merged into one file when it has more files than this.
LOG_FILES = 64

_LOG = "version long, folder string, source string, parts int, staged string"


class _Line(NamedTuple):
    """A line of the log: a version, the folder of its data, who wrote it, and where changed parts lie that are not yet in that folder."""

    version: int = 0
    folder: str | None = None
    source: str | None = None
    parts: int | None = None
    staged: str | None = None


def _log(spark: SparkSession, path: str) -> list[_Line]:
    """The lines of the log, oldest first. A version that was staged and then finished has two, the finished one last."""
    try:
        lines = spark.read.schema(_LOG).json(f"{path}/versions").collect()
    except AnalysisException as error:
        if not is_missing_path(error):
            raise
        return []
    return sorted((_Line(*line) for line in lines), key=lambda line: (line.version, line.staged is None))


def _say(spark: SparkSession, path: str, *lines: _Line) -> None:
    spark.createDataFrame(lines, _LOG).coalesce(1).write.mode("append").json(f"{path}/versions")


def _stream(source: str | None) -> str:
    return (source or "").rpartition(":")[0]


def _merge_log(spark: SparkSession, path: str) -> None:
    """Keep the log short: of each folder and stream only the newest line. Lines are repeated before the old files go."""
    location, files = hadoop_path(spark, f"{path}/versions")
    old = [f.getPath() for f in files.listStatus(location) if f.getPath().getName().startswith("part-")]
    if len(old) > LOG_FILES:
        _say(spark, path, *{(line.folder, _stream(line.source)): line for line in _log(spark, path)}.values())
        for file in old:
            files.delete(file, False)


def state_version(spark: SparkSession, path: str, source: str | None = None) -> tuple[int, str | None]:
    """Newest version and its folder, ``(0, None)`` for none. With ``source``, of the versions it wrote."""
    lines = [line for line in _log(spark, path) if source is None or line.source == source]
    return (lines[-1].version, lines[-1].folder) if lines else (0, None)


def state_part(keys: Sequence[str], parts: int) -> Column:
    """The part of a state table in which a key lies."""
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def _rows(spark: SparkSession, path: str, line: _Line, parts: Sequence[int] | None = None) -> DataFrame:
    """The rows of a version with their ``part``; of some parts only, whose folders alone are then read."""
    live = spark.read.parquet(f"{path}/{line.folder}")
    if line.parts is None:
        return live.withColumn("part", F.lit(0))
    if line.staged is not None:
        changed = spark.read.parquet(f"{path}/{line.staged}")
        there = [r[0] for r in changed.select("part").distinct().collect()]
        live = live.filter(~F.col("part").isin(there)).unionByName(changed)
    if parts is not None:
        live = live.filter(F.col("part").isin(list(parts)))
    return live.filter(~F.col("schema_name").eqNullSafe(F.lit(None)))


def _write_parts(rows: DataFrame, parts: Sequence[int], path: str) -> None:
    """Write rows with their ``part``. Each of ``parts`` gets a row without key, so that it has a file even without rows."""
    marks = rows.sparkSession.createDataFrame([(p,) for p in parts], "part int")
    rows.unionByName(marks, allowMissingColumns=True).hint("rebalance", "part").write.partitionBy("part").parquet(path)


def read_state(spark: SparkSession, path: str, fleet: Sequence[str] = ()) -> DataFrame:
    """The newest state; a missing table reads as an empty one."""
    lines = _log(spark, path)
    return _rows(spark, path, lines[-1]).drop("part") if lines else empty_state(spark, fleet)


def write_state(state: DataFrame, path: str, source: str | None = None, parts: int | None = None) -> int:
    """Write a whole new version of the state and make it the current one.

    The data goes to a new folder, in ``parts`` folders by hash of the key (as many as before, or ``STATE_PARTS``). Only when
    that is complete does one line in ``versions`` name it as current, so a reader never sees half a table and a job may read
    the version it replaces. ``source`` marks who wrote it; one writer at a time.
    """
    spark = state.sparkSession
    last = (_log(spark, path) or [_Line()])[-1]
    parts = parts or last.parts or STATE_PARTS
    line = _Line(last.version + 1, f"data/{last.version + 1:012d}-{uuid.uuid4().hex}", source, parts)
    rows = state.select(*fleet_keys(state), *STATE_SCHEMA.names).withColumn("part", state_part(index_keys(state), parts))
    _write_parts(rows, [0], f"{path}/{line.folder}")
    _say(spark, path, line)
    _merge_log(spark, path)
    return line.version


def update_state(
    spark: SparkSession, path: str, keys: DataFrame | Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], DataFrame],
    source: str | None = None,
) -> int:
    """Change some rows of the current state in place: only the parts in which ``keys`` lie are read and written.

    ``keys`` may be a function that picks them from the state. ``change`` gets the rows of their parts and returns what they
    become; keys it adds must be among ``keys``. A large table with many parts thus costs what the touched parts cost. The changed parts are first written beside the table and named in
    the log, and then take the place of the old ones by Spark's dynamic partition overwrite. If that is interrupted, readers
    go by the log, and the next update finishes it. A ``source`` that the log already names is not applied again; 0 is
    returned then, else the new version. Who reads the table while parts are replaced may have to read again.
    """
    lines = _log(spark, path)
    if not lines:
        raise ValueError(f"there is no state at {path}; write one first")
    if source is not None and any(line.source == source for line in lines):
        _finish(spark, path, lines[-1])
        return 0
    last = lines[-1]
    if last.parts is None:  # written before states had parts
        return write_state(change(_rows(spark, path, last).drop("part")), path, source)
    _finish(spark, path, last)
    last = last._replace(staged=None)
    state = _rows(spark, path, last).drop("part")
    keys = keys(state) if callable(keys) else keys
    same_fleet(state, keys)
    names, types = index_keys(state), dict(state.dtypes)
    # One number per part: bounded by the number of parts, whatever the number of keys.
    of_keys = keys.select(*[F.col(c).cast(types[c]).alias(c) for c in names])
    touched = sorted(r[0] for r in of_keys.select(state_part(names, last.parts).alias("part")).distinct().collect())
    line = _Line(last.version + 1, last.folder, source, last.parts, f"staged/{last.version + 1:012d}-{uuid.uuid4().hex}")
    if not touched:
        _say(spark, path, line._replace(staged=None))
        return line.version
    new = change(_rows(spark, path, last, touched).drop("part"))
    # A part that loses all its rows still has to be replaced.
    _write_parts(new.select(*state.columns).withColumn("part", state_part(names, last.parts)), touched, f"{path}/{line.staged}")
    _say(spark, path, line)
    _finish(spark, path, line)
    return line.version


def _finish(spark: SparkSession, path: str, line: _Line) -> None:
    """Move staged parts to their place; doing it again changes nothing."""
    if line.staged is None:
        return
    changed = spark.read.parquet(f"{path}/{line.staged}")
    changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/{line.folder}")
    _say(spark, path, line._replace(staged=None))
    location, files = hadoop_path(spark, f"{path}/{line.staged}")
    files.delete(location, True)
    _merge_log(spark, path)


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove the data of all but the newest versions that is still there; their log lines stay. Returns how many were removed."""
    lines = _log(spark, path)
    if not lines:
        return 0
    current = {line.folder for line in lines if line.version > lines[-1].version - max(keep, 1)}
    removed = 0
    for folder in {line.folder for line in lines} - current:
        location, files = hadoop_path(spark, f"{path}/{folder}")
        removed += bool(files.exists(location) and files.delete(location, True))
    return removed
