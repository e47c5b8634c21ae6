"""Predicates. They are plain conditions, so they reach the scans below the joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import is_temp_rebuild_name, parse_index_kind, split_names, validate_schemas, validate_size_band
from ..keys import fleet_keys

GIB = 1 << 30

# Schemas of the server itself, and patterns of its temporary schemas
# ("_" is a wildcard here as it is on the server).
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema", "pg_toast", "pg_temp_1", "pg_toast_temp_1")
TEMPORARY_SCHEMAS = ("pg_temp_%", "pg_toast_temp_%")


def schema_list(spark: SparkSession, schemas: str | Sequence[str], limited: bool = True) -> DataFrame:
    """Requested schemas as rows ``(schema_name, schema_ord)``, repeats included. A run takes at most 512, a plan any number."""
    names = split_names(schemas) if isinstance(schemas, str) else list(schemas)
    if limited:
        validate_schemas(names)
    return spark.createDataFrame(list(zip(names, range(1, len(names) + 1))), "schema_name string, schema_ord int")


def dedupe_schemas(requested: DataFrame) -> DataFrame:
    """First occurrence of each name, order kept."""
    return requested.groupBy(*fleet_keys(requested), "schema_name").agg(F.min("schema_ord").alias("schema_ord"))


def schema_duplicates(requested: DataFrame) -> DataFrame:
    """How many repeats ``dedupe_schemas`` drops."""
    lead = fleet_keys(requested)
    per_name = requested.groupBy(*lead, "schema_name").agg(F.count(F.lit(1)).alias("n"))
    return per_name.groupBy(*lead).agg(
        F.coalesce(F.sum("n") - F.count(F.lit(1)), F.lit(0)).cast("bigint").alias("duplicate_count"),
        F.count(F.lit(1)).alias("distinct_count"),
    )


def filter_schemas(df: DataFrame, schemas: Sequence[str] | DataFrame, column: str = "schema_name") -> DataFrame:
    """Keep the listed schemas. A list is at most 512 names; a frame may be of any size."""
    if isinstance(schemas, DataFrame):
        lead = fleet_keys(df, schemas)
        wanted = schemas.select(*lead, F.col("schema_name").alias(column))
        return df.join(wanted, [*lead, column], "left_semi").select(*df.columns)
    return df.filter(F.col(column).isin(validate_schemas(schemas)))


def filter_relkind(df: DataFrame, relkind: str, column: str = "relkind") -> DataFrame:
    """Keep relations of one kind: ``i`` index, ``r`` table, ``p`` partitioned table."""
    return df.filter(F.col(column) == relkind)


def filter_table(df: DataFrame, table: str | None) -> DataFrame:
    """Keep the indexes of one table; no table keeps all."""
    return df if table is None else df.filter(F.col("table_name") == table)


def filter_index_kind(df: DataFrame, kind: str) -> DataFrame:
    """``btree``: b-tree and not a constraint; ``constraint``: primary or unique;
    ``all``: any access method, still without constraints."""
    constraint = F.col("is_primary") | F.col("is_unique")
    condition = {
        "btree": ~constraint & (F.col("index_type") == "btree"),
        "constraint": constraint,
        "all": ~constraint,
    }
    return df.filter(condition[parse_index_kind(kind)])


def filter_size_gb(df: DataFrame, min_gb: int, max_gb: int | None = None, column: str = "size_bytes") -> DataFrame:
    """Keep ``min_gb <= size < max_gb`` in gibibytes; no upper bound for None."""
    low, high = validate_size_band(min_gb, max_gb)
    rows = df.filter(F.col(column) >= F.lit(low * GIB).cast("bigint"))
    return rows if high is None else rows.filter(F.col(column) < F.lit(high * GIB).cast("bigint"))


def is_user_schema(name: Column, tool_schemas: Sequence[str] = ()) -> Column:
    """Not a schema of the server, not temporary and not one that a maintenance tool keeps for itself."""
    keep = ~name.isin([*SYSTEM_SCHEMAS, *tool_schemas])
    for pattern in TEMPORARY_SCHEMAS:
        keep = keep & ~name.like(pattern)
    return keep


def user_schemas(namespace: DataFrame, tool_schemas: Sequence[str] = ()) -> DataFrame:
    """All user schemas, by name."""
    lead = fleet_keys(namespace)
    kept = namespace.filter(is_user_schema(F.col("nspname"), tool_schemas))
    return kept.select(*lead, F.col("nspname").alias("schema_name")).orderBy(*lead, "schema_name")


def drop_excluded(df: DataFrame, names: Sequence[str] | DataFrame) -> DataFrame:
    """Drop indexes by name only: any schema, exact case."""
    if isinstance(names, DataFrame):
        return df.join(names.select("index_name"), "index_name", "left_anti").select(*df.columns)
    return df.filter(~F.col("index_name").isin(list(names))) if names else df


def drop_temp_rebuilds(df: DataFrame) -> DataFrame:
    """Drop the leftovers of concurrent rebuilds."""
    return df.filter(~is_temp_rebuild_name(F.col("index_name")))
