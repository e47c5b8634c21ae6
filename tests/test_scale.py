"""Plans and data layouts that must hold when one key has a third of all rows."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from indexward import schemas as S
from indexward.operators import inventory, ranking, schedule, state
from indexward.sources import drop_scratch, load_catalog_tables, materialize, save_catalog_tables, scratch_dir
from indexward.sources.scratch import materialize_once, scratch_table

from conftest import rows


@pytest.fixture
def settings(spark):
    changed = []

    def change(**values):
        for name, value in values.items():
            key = "spark.sql." + name.replace("__", ".")
            changed.append((key, spark.conf.get(key, None)))
            spark.conf.set(key, value)

    yield change
    for key, value in reversed(changed):
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def executed(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def hot_catalog(spark, tmp_path):
    """One table holds two of five indexes."""
    n = 60_000
    ids = spark.range(n)
    table = F.when(F.col("id") % 5 < 2, F.lit(0)).otherwise(F.col("id") % 997 + 1)
    index = ids.select(
        (F.col("id") + 10_000).alias("indexrelid"), table.alias("indrelid"), F.lit(False).alias("indisprimary"),
        F.lit(False).alias("indisunique"), *[F.lit(True).alias(c) for c in ("indisvalid", "indisready", "indislive")],
    )
    own = ids.select((F.col("id") + 10_000).alias("oid"), F.concat(F.lit("i"), "id").alias("relname"), F.lit("i").alias("relkind"))
    tables = spark.range(998).select(F.col("id").alias("oid"), F.concat(F.lit("t"), "id").alias("relname"), F.lit("r").alias("relkind"))
    classes = own.unionByName(tables).select(
        "oid", "relname", F.lit(1).cast("bigint").alias("relnamespace"), "relkind", F.lit(1).cast("bigint").alias("relam"),
        *[(F.col("oid") % 100 + 1).alias(c) for c in ("relpages", "reltuples", "relsize")],
    )
    cat = {
        "namespace": spark.createDataFrame([(1, "app")], S.NAMESPACE), "am": spark.createDataFrame([(1, "btree")], S.AM),
        "class": classes, "index": index, "stat_index": spark.createDataFrame([], S.STAT_INDEX),
        "inherits": spark.createDataFrame([], S.INHERITS),
    }
    for name, df in cat.items():
        df.write.parquet(f"{tmp_path}/{name}")
    return {name: spark.read.parquet(f"{tmp_path}/{name}") for name in cat}


def test_a_hot_table_is_split_in_the_join(spark, settings, hot_catalog):
    settings(
        autoBroadcastJoinThreshold=-1, adaptive__autoBroadcastJoinThreshold=-1, shuffle__partitions=16,
        adaptive__skewJoin__skewedPartitionThresholdInBytes="60KB", adaptive__skewJoin__skewedPartitionFactor=2,
        adaptive__advisoryPartitionSizeInBytes="40KB",
    )
    got = inventory.index_inventory(hot_catalog, kind="all")
    assert "skew=true" in executed(got)
    assert got.count() == 60_000


def test_a_hot_table_is_split_in_the_schedule(hot_catalog):
    rows_ = inventory.index_inventory(hot_catalog, kind="all")
    got = schedule.conflict_free_waves(rows_, 8, hot_rows=1000)
    assert got.agg(F.max("wave")).first()[0] == 24_000
    assert got.groupBy("table_name", "wave").count().filter("count > 1").count() == 0


def test_bucketed_snapshots_join_without_shuffles(spark, settings, cat, tmp_path):
    settings(autoBroadcastJoinThreshold=-1, adaptive__enabled=False)
    save_catalog_tables(cat, str(tmp_path), "snap", 4)
    try:
        tables = load_catalog_tables(spark, "snap")
        got = ranking.plan_inventory(tables, ["shop"])
        assert rows(got) == rows(ranking.plan_inventory(cat, ["shop"]))
        by_id = r"Exchange hashpartitioning\((index_oid|indexrelid|oid)#"
        assert not re.search(by_id, got._jdf.queryExecution().executedPlan().toString())
        plain = ranking.plan_inventory(cat, ["shop"])._jdf.queryExecution().executedPlan().toString()
        assert re.search(by_id, plain)
    finally:
        for name in cat:
            spark.sql(f"DROP TABLE IF EXISTS snap_{name}")


def test_updates_of_one_hot_index_are_combined_before_the_shuffle(spark):
    upd = spark.range(1000).select(F.lit("s").alias("schema_name"), F.lit("i").alias("index_name"), F.lit("failed").alias("state"), F.col("id").alias("seq"))
    got = state.apply_states(S.empty_state(spark), upd, dt.datetime(2002, 1, 1), order="seq")
    assert "partial_max_by" in got._jdf.queryExecution().executedPlan().toString()


def test_scratch_tables(spark):
    assert scratch_dir(spark).startswith("file:") and spark.conf.get("spark.checkpoint.dir").removeprefix("file:") in scratch_dir(spark)
    kept = materialize(spark.range(5).toDF("id"), "kept")
    assert kept.count() == 5
    with scratch_table(spark.range(3).toDF("id"), "brief") as brief:
        folder = brief.inputFiles()[0].rsplit("/", 1)[0]
        assert brief.count() == 3
    assert folder not in {f.rsplit("/", 1)[0] for f in kept.inputFiles()}
    calls = []

    def build():
        calls.append(1)
        return spark.range(2).toDF("id")

    assert [materialize_once(spark, ("k",), "once", build).count() for _ in range(2)] == [2, 2] and len(calls) == 1
    drop_scratch(spark)
    assert materialize_once(spark, ("k",), "once", build).count() == 2 and len(calls) == 2


def test_classes_are_reduced_to_the_wanted_names_before_the_shuffle(spark, settings, hot_catalog, monkeypatch):
    settings(autoBroadcastJoinThreshold=-1, adaptive__autoBroadcastJoinThreshold=-1)
    keys = spark.createDataFrame([("app", f"i{n}") for n in range(0, 60, 3)] + [("app", "none")], "schema_name string, index_name string")
    for find, flag in ((inventory.index_size, "current_size"), (inventory.index_integrity, "healthy")):
        plan = executed(find(hot_catalog, keys))
        reduced = plan.index("BroadcastHashJoin [relname")
        # Everything above the reduced scan up to the first exchange over it handles the wanted rows only.
        assert "LeftSemi" in plan[reduced : reduced + 200] and plan.count("BroadcastHashJoin [relname") >= 1
        want = rows(find(hot_catalog, keys), "index_name", flag)
        with monkeypatch.context() as many:
            many.setattr(inventory, "MAX_BROADCAST_NAMES", 0)
            assert "BroadcastHashJoin [relname" not in executed(find(hot_catalog, keys))
            assert rows(find(hot_catalog, keys), "index_name", flag) == want
