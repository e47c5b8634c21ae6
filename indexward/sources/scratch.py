"""Intermediate tables in the shared folder of the cluster.

Written tables cut the lineage and survive the loss of an executor. The folder
is ``spark.checkpoint.dir`` of the session; only a local session without that
setting falls back to a temporary folder of this process.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_local_folder: tempfile.TemporaryDirectory | None = None
_written: dict[tuple, tuple[str, T.StructType, str | None]] = {}

#: Intermediate tables are read once or twice: what compresses best takes the least of the shared folder.
_CODEC = "zstd"


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme that Spark reads it by, for readers and writers that would take a bare path for a local one."""
    location, files = hadoop_path(spark, path)
    return files.makeQualified(location).toString()


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables of this application, with its scheme."""
    global _local_folder
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared:
        return qualified(spark, f"{shared.rstrip('/')}/indexward/{context.applicationId}")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_folder is None:
        _local_folder = tempfile.TemporaryDirectory(prefix="indexward-")
    return f"file://{_local_folder.name}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path for an intermediate table."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, for what readers and writers do not offer: existence and removal."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark._jsc.hadoopConfiguration())


def table_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files of a table, of one file or a folder."""
    location, files = hadoop_path(spark, path)
    return files.getContentSummary(location).getLength()


def drop_scratch(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application. Frames that still read them become unusable."""
    location, files = hadoop_path(spark, scratch_dir(spark))
    files.delete(location, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Compute ``df`` once into a parquet table and return a reader of it.

    Later passes read only the columns they need.
    """
    path = scratch_path(df.sparkSession, label)
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write(df: DataFrame, path: str) -> None:
    df.write.parquet(path, compression=_CODEC)


@contextmanager
def scratch_table(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """As ``materialize``, for a table that is needed only inside a ``with`` block and removed after it."""
    path = scratch_path(df.sparkSession, label)
    _write(df, path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        location, files = hadoop_path(df.sparkSession, path)
        files.delete(location, True)


def written(spark: SparkSession, key: tuple) -> DataFrame | None:
    """The table that ``materialize_once`` of this application has written for ``key``, if it is still there."""
    known = _written.get((spark.sparkContext.applicationId, *key))
    if known:
        path, schema, table = known
        location, files = hadoop_path(spark, f"{path}/_SUCCESS")
        if files.exists(location):
            return spark.table(table) if table else spark.read.schema(schema).parquet(path)
    return None


def materialize_once(spark: SparkSession, key: tuple, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """As ``materialize``, but a table this application has already written for ``key`` is read again."""
    known = written(spark, key)
    if known is not None:
        return known
    df = build()
    path = scratch_path(spark, label)
    _write(df, path)
    _written[(spark.sparkContext.applicationId, *key)] = (path, df.schema, None)
    return spark.read.schema(df.schema).parquet(path)


def materialize_once_by(spark: SparkSession, key: tuple, label: str, build: Callable[[int], DataFrame], by: str) -> DataFrame:
    """As ``materialize_once``, in one file per bucket of a column, so that joins and aggregates by it need no shuffle.

    ``build`` gets the number of buckets and returns rows that are already dealt to as many partitions by that column.
    """
    known = written(spark, key)
    if known is not None:
        return known
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = build(buckets)
    path, table = scratch_path(spark, label), f"{label}_{uuid.uuid4().hex}"
    df.write.option("path", path).option("compression", _CODEC).bucketBy(buckets, by).format("parquet").saveAsTable(table)
    _written[(spark.sparkContext.applicationId, *key)] = (path, df.schema, table)
    return spark.table(table)
