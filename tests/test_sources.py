import pytest
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from indexward import schemas as S
from indexward.operators import filters, inventory, state
from indexward.sources import catalog, load_activity, load_activity_jdbc, load_catalog, load_catalog_jdbc

from conftest import rows


def test_snapshots_of_old_servers_read_as_nulls(spark, cat, tmp_path):
    for name, df in cat.items():
        (df.drop("last_idx_scan") if name == "stat_index" else df).write.parquet(f"{tmp_path}/{name}")
    got = load_catalog(spark, f"{tmp_path}/")
    assert rows(got["stat_index"], "idx_scan", "last_idx_scan") == [(0, None), (5, None), (7, None)]
    assert inventory.index_inventory(got, kind="all").count() == 6


def test_activity(spark, tmp_path):
    for name, schema in S.ACTIVITY_RELATIONS.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
    got = load_activity(spark, str(tmp_path))
    assert set(got) == {"activity", "slots", "settings", "repl_samples"} and got["slots"].columns == ["instance_id", "slot_name", "active"]


@pytest.mark.parametrize("old", [False, True])
def test_jdbc_reads_are_split_by_object_id(spark, cat, monkeypatch, old):
    """No database here: only what is asked of the reader is checked."""
    asked = []

    def jdbc(self, url, table, **options):
        asked.append((table, options))
        name = next(n for n, schema in S.CATALOG.items() if schema.names[0] == options["column"] and f"AS {schema.names[1]}" in table or n == "stat_index" and "pg_stat_user_indexes" in table)
        return cat[name].drop("last_idx_scan") if old else cat[name]

    monkeypatch.setattr(DataFrameReader, "jdbc", jdbc)
    got = load_catalog_jdbc(spark, "jdbc:postgresql://host/db", {"user": "u"}, max_oid=500, partitions=3, old_server=old)
    assert set(got) == set(S.CATALOG) and len(asked) == 6
    assert all(o["numPartitions"] == 3 and o["upperBound"] == 500 and o["column"] in ("oid", "indexrelid", "inhrelid") for _, o in asked)
    assert "last_idx_scan" in got["stat_index"].columns
    assert any("last_idx_scan" in t for t, _ in asked) != old


def test_jdbc_reads_of_one_server_snapshot_in_equal_parts(spark, cat, monkeypatch):
    """No database here: only what is asked of the reader is checked."""
    asked = []

    def jdbc(self, url, table, **options):
        asked.append(options)
        return spark.createDataFrame([], "idx_scan bigint, last_idx_scan timestamp")

    monkeypatch.setattr(DataFrameReader, "jdbc", jdbc)
    bounds = {name: [40, 10, 40] for name in S.CATALOG}
    load_catalog_jdbc(spark, "jdbc:postgresql://host/db", {"user": "u"}, snapshot="00000003-0000001B-1", bounds=bounds)
    assert len(asked) == 6
    for options in asked:
        assert options["properties"]["sessionInitStatement"].endswith("SET TRANSACTION SNAPSHOT '00000003-0000001B-1'")
        assert "REPEATABLE READ" in options["properties"]["sessionInitStatement"] and int(options["properties"]["fetchsize"]) > 0
        column = options["predicates"][0].split()[0]
        assert options["predicates"] == [f"{column} < 10", f"{column} >= 10 AND {column} < 40", f"{column} >= 40"]
    assert catalog.oid_predicates("oid", []) == ["TRUE"]
    assert catalog.oid_bounds_sql("index", 4) == (
        "SELECT percentile_disc(ARRAY[0.250000, 0.500000, 0.750000]) WITHIN GROUP (ORDER BY indexrelid::bigint) AS bounds FROM pg_index"
    )
    for wrong in ({"snapshot": "x'; DROP"}, {"bounds": {"class": [1]}}):
        with pytest.raises(ValueError):
            load_catalog_jdbc(spark, "jdbc:postgresql://host/db", {}, **wrong)


def test_jdbc_activity_layout(spark, monkeypatch):
    """No database here: only the statements and the layout are checked."""
    asked = []

    def jdbc(self, url, table, **options):
        asked.append(table)
        name = next(n for n, view in (("activity", "pg_stat_activity"), ("slots", "pg_replication_slots"), ("settings", "pg_settings"), ("repl_samples", "pg_stat_replication")) if view in table)
        layout = S.ACTIVITY_RELATIONS[name]
        assert all(c in table for c in layout.names[1:])
        return spark.createDataFrame([], layout).drop("instance_id")

    monkeypatch.setattr(DataFrameReader, "jdbc", jdbc)
    got = load_activity_jdbc(spark, "jdbc:postgresql://host/db", {"user": "u"}, 7)
    assert len(asked) == 4 and {n: f.columns for n, f in got.items()} == {n: s.names for n, s in S.ACTIVITY_RELATIONS.items()}


def test_filters_take_lists_and_frames(spark, cat):
    wide = inventory.index_inventory(cat, kind="all")
    frame = spark.createDataFrame([("shop",), ("shop",)], "schema_name string")
    assert rows(filters.filter_schemas(wide, frame)) == rows(filters.filter_schemas(wide, ["shop"]))
    names = spark.createDataFrame([("users_gin",)], "index_name string")
    assert rows(filters.drop_excluded(wide, names)) == rows(filters.drop_excluded(wide, ["users_gin"]))
    assert rows(filters.drop_excluded(wide, [])) == rows(wide)
    assert rows(filters.drop_excluded(wide, ["USERS_GIN"])) == rows(wide)
    assert filters.drop_temp_rebuilds(wide).count() == 5
    assert rows(filters.filter_relkind(cat["class"], "p"), "relname") == [("empty_log",), ("log",)]
    pending = spark.createDataFrame([("s", "t", "i", "btree", "pending", None, None, None)], S.STATE_SCHEMA)
    assert state.load_pending(pending, spark.createDataFrame([("s",)], "schema_name string")).count() == 1
    with pytest.raises(ValueError):
        filters.schema_list(spark, " , ")


def test_a_plan_takes_any_number_of_schemas(cat):
    from indexward.operators import ranking

    many = [f"s{i}" for i in range(600)] + ["shop"]
    assert ranking.plan_inventory(cat, many).count() == 6
    with pytest.raises(ValueError):
        inventory.index_inventory(cat, many)


def test_partition_order(cat):
    got = inventory.order_by_name(inventory.index_inventory(cat, ["shop", "audit"], kind="all"))
    names = [(r.schema_name, r.index_name) for r in got.select("schema_name", "index_name").collect()]
    assert names == [("shop", "log_2_idx"), ("shop", "orders_a_ccnew"), ("shop", "users_gin"), ("shop", "users_name"), ("audit", "log_1_idx"), ("audit", "users_name")]
    parts = inventory.order_by_name(inventory.table_partitions(cat)).select("partition_name").collect()
    assert [r[0] for r in parts] == ["log_1", "log_2"]


def test_lag_flags_of_missing_columns(spark):
    df = spark.createDataFrame([(1, None, True)], "instance_id long, state string, active boolean")
    assert df.filter(state.is_stuck()).count() == 0 and df.select(F.col("active")).first()[0]
