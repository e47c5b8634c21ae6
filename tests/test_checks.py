"""Every registered query against its SQL, over whole tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from indexward import checks
from indexward.checks.queries import _REGISTRY

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


# Spark types and the DuckDB types they must meet.
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i] + 0.0) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in data)


def test_every_query_has_its_sql():
    assert set(checks.queries()) == set(checks.oracle_sql()) == set(_REGISTRY)
    assert set(_REGISTRY) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(_REGISTRY))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(got.columns) == sorted(columns)
    assert {c: TYPES[t] for c, t in got.dtypes} == {d[0]: str(d[1]) for d in result.description}
    data = got.collect()
    assert data
    assert table(got.columns, data) == table(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 3405
