import pytest
from pyspark.sql import functions as F

from indexward.operators import inventory as inv
from indexward.operators import ranking, schedule
from indexward.sources import load_catalog, with_scan_compat

from conftest import rows

NAMES = ("schema_name", "index_name")


def test_kinds_and_user_schemas(cat):
    assert rows(inv.index_inventory(cat, kind="btree"), *NAMES) == [
        ("audit", "users_name"), ("shop", "log_2_idx"), ("shop", "orders_a_ccnew"), ("shop", "users_name"),
    ]
    assert rows(inv.index_inventory(cat, kind="constraint"), *NAMES) == [("shop", "users_pk"), ("shop", "users_uq")]
    everything = rows(inv.index_inventory(cat, kind="all"), *NAMES)
    assert ("shop", "users_gin") in everything and ("audit", "log_1_idx") in everything
    assert not {("shop", "users_pk"), ("shop", "users_uq"), ("pg_catalog", "sys_idx"), ("shop", "log_parent_idx")} & set(everything)


def test_size_band_is_half_open(cat):
    got = rows(inv.index_inventory(cat, kind="all", min_gb=2, max_gb=5), "index_name", "index_size")
    assert got == [("orders_a_ccnew", "5.00 GB"), ("users_gin", "2.00 GB")]
    with pytest.raises(ValueError):
        inv.index_inventory(cat, min_gb=5, max_gb=1)


def test_one_table_and_listed_schemas(cat):
    assert rows(inv.index_inventory(cat, ["audit"], "users", kind="all"), *NAMES) == [("audit", "users_name")]
    assert rows(inv.index_inventory(cat, "pg_catalog", kind="all"), *NAMES) == [("pg_catalog", "sys_idx")]
    # A list given twice counts once here, but repeats rows in a plan.
    assert inv.index_inventory(cat, "audit,audit", kind="btree").count() == 1
    assert ranking.plan_inventory(cat, "audit,audit").count() == 4


def test_partitions(cat):
    got = rows(inv.table_partitions(cat, table="log"), "parent_schema", "parent_table_name", "partition_schema", "partition_name")
    assert got == [("shop", "log", "audit", "log_1"), ("shop", "log", "shop", "log_2")]
    assert rows(inv.partitioned_tables(cat), "schema_name", "table_name", "partition_count") == [
        ("shop", "empty_log", 0), ("shop", "log", 2),
    ]
    got = rows(inv.partition_indexes(cat, ["shop"]), "schema_name", "index_name", "index_type", "parent_table_name")
    assert got == [("audit", "log_1_idx", "hash", "log"), ("shop", "log_2_idx", "btree", "log")]
    assert inv.partition_indexes(cat, ["audit"]).count() == 0


def test_union_with_partitions_keeps_the_last_row(cat):
    both = inv.inventory_union(cat, ["shop"], kind="btree", include_partitions=True)
    assert [r[0] for r in rows(both, "index_name")].count("log_2_idx") == 2
    once = inv.dedupe_last_wins(both)
    assert rows(once.filter("index_name = 'log_2_idx'"), "parent_table_name", "pass") == [("log", 1)]
    # audit is listed after shop, so its own regular row replaces the one found through the parent in shop.
    both = inv.inventory_union(cat, ["shop", "audit"], kind="all", include_partitions=True)
    last = inv.dedupe_last_wins(both).filter("index_name = 'log_1_idx'")
    assert rows(last, "schema_name", "parent_table_name", "pass") == [("audit", None, 0)]


def test_one_partitioned_table_gives_its_partitions_only(cat):
    got = inv.inventory_union(cat, ["shop", "audit"], "log", kind="constraint", include_partitions=True)
    assert rows(got, "index_name", "pass") == [("log_1_idx", 1), ("log_2_idx", 1)]
    plain = inv.inventory_union(cat, ["shop", "audit"], "users", kind="btree", include_partitions=True)
    assert rows(plain, *NAMES) == [("audit", "users_name"), ("shop", "users_name")]


def test_existence(cat):
    got = rows(inv.existence(cat, ["shop", "audit", "none"], "log"), "schema_name", "schema_exists", "table_exists", "is_partitioned")
    assert got == [("audit", True, False, False), ("none", False, False, False), ("shop", True, False, True)]
    got = rows(inv.existence(cat, ["shop"], "empty_log"), "is_partitioned")
    assert got == [(False,)]
    got = rows(inv.existence(cat, ["shop", "audit"], "users"), "table_exists")
    assert got == [(True,), (True,)]
    assert rows(inv.existence(cat, ["shop"]), "schema_exists", "table_exists") == [(True, False)]


def test_lookups_by_name(spark, cat):
    keys = spark.createDataFrame([("shop", "users_gin"), ("audit", "users_name"), ("shop", "nope"), ("shop", "log_parent_idx")], "schema_name string, index_name string")
    got = {r.index_name: (r.current_size, r.missing) for r in inv.index_size(cat, keys).collect()}
    assert got["nope"] == (None, True) and got["users_name"] == (5 << 30, False) and got["log_parent_idx"] == (0, False)
    got = {r.index_name: r.healthy for r in inv.index_integrity(cat, keys).collect()}
    assert got == {"users_gin": False, "users_name": True, "nope": False, "log_parent_idx": False}


def test_leftovers(cat):
    got = inv.temp_rebuild_candidates(cat, inv.index_inventory(cat, kind="all"))
    assert rows(got, "index_name", "healthy") == [("orders_a_ccnew", False)]


def test_drift_joins_by_id_not_by_name(cat):
    got = {(r.schema_name, r.index_name): r.bloat_percentage for r in inv.page_drift(cat).collect()}
    assert got[("shop", "users_name")] == 60 - 12.5
    assert got[("audit", "users_name")] == 10 - 500.0
    assert got[("shop", "orders_a_ccnew")] == 0.0


def test_old_servers_have_no_last_scan(cat):
    old = {**cat, "stat_index": with_scan_compat(cat["stat_index"].drop("last_idx_scan"))}
    got = ranking.plan_inventory(old, ["shop"])
    assert got.filter("last_scan IS NOT NULL OR last_scan_epoch IS NOT NULL").count() == 0
    assert got.schema == ranking.plan_inventory(cat, ["shop"]).schema


def test_plan_inventory_values(cat):
    got = {r.index_name: r for r in ranking.plan_inventory(cat, ["shop"]).collect()}
    assert set(got) == {"users_pk", "users_uq", "users_name", "users_gin", "orders_a_ccnew", "log_2_idx"}
    row = got["users_pk"]
    assert (row.last_scan, row.last_scan_epoch, row.scan_count) == ("2001-01-01T12:00:00Z", 978350401, 5)
    assert got["users_name"].estimated_bloat_percent == pytest.approx(10.0)
    assert got["users_gin"].scan_count == 0 and got["users_gin"].size_pretty == "2048 MB"


def test_fleet_keys_keep_instances_apart(spark, cat, tmp_path):
    for name, df in cat.items():
        both = df.withColumn("instance_id", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))))
        both.write.parquet(f"{tmp_path}/{name}")
    fleet = load_catalog(spark, str(tmp_path), fleet=("instance_id",))
    assert inv.index_inventory(fleet, kind="all").count() == 2 * inv.index_inventory(cat, kind="all").count()
    assert rows(inv.existence(fleet, ["shop"], "log"), "instance_id", "schema_name", "is_partitioned") == [
        (1, "shop", True), (2, "shop", True),
    ]
    waves = schedule.conflict_free_waves(inv.index_inventory(fleet, kind="all"), 4)
    assert waves.groupBy("instance_id", "schema_name", "table_name", "wave").count().filter("count > 1").count() == 0


def test_size_order_is_global_and_monotone(cat):
    got = [r.size_bytes for r in inv.order_by_size(inv.index_inventory(cat, ["shop", "audit"], kind="all"), "desc").collect()]
    assert got == sorted(got, reverse=True) and len(got) == 6
    names = [(r.schema_name, r.index_name) for r in inv.order_by_size(inv.index_inventory(cat, ["shop", "audit"], kind="all")).collect()]
    assert names[:3] == [("shop", "log_2_idx"), ("shop", "users_name"), ("audit", "log_1_idx")]


def test_filters_reach_the_scans(spark, cat, tmp_path):
    for name, df in cat.items():
        df.write.parquet(f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = inv.index_inventory(load_catalog(spark, str(tmp_path)), ["shop"], kind="btree", min_gb=1, max_gb=5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(relkind,i)" in text and "GreaterThanOrEqual(relsize,1073741824)" in text
    assert "EqualTo(nspname,shop)" in text and "EqualTo(amname,btree)" in text
    assert "reltuples" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_no_index_is_too_large_by_default(spark, cat):
    huge = {**cat, "class": cat["class"].withColumn("relsize", F.col("relsize") * 4096)}
    assert inv.index_inventory(huge, kind="all").count() == inv.index_inventory(cat, kind="all").count()


def test_before_snapshot_of_a_worklist(cat):
    work = cat["index"].filter("indexrelid IN (20, 24)").selectExpr("indexrelid AS index_oid")
    whole = inv.before_snapshot(cat).filter("index_oid IN (20, 24)")
    assert rows(inv.before_snapshot(cat, work), *whole.columns) == rows(whole)


def _repeated(spark, cat):
    """A snapshot in which one index id stands for two indexes of one name on two tables, of different health."""
    twice = spark.createDataFrame([(21, 16, False, False, True, False, True)], cat["index"].schema)
    return {**cat, "index": cat["index"].unionByName(twice)}


def test_integrity_of_a_repeated_name_is_one_row_per_key(spark, cat):
    repeated = _repeated(spark, cat)
    keys = inv.index_inventory(repeated, kind="all").filter("index_name = 'users_name' AND schema_name = 'shop'")
    named = keys.select("schema_name", "table_name", "index_name")
    got = inv.index_integrity(repeated, named, by_table=True).select("table_name", "healthy")
    assert rows(got) == [("log_2", False), ("users", True)]
    assert rows(inv.index_integrity(repeated, named), "healthy") == [(False,), (False,)]
    assert rows(inv.index_integrity(repeated, keys, by_table=True), "table_name", "healthy") == [("log_2", False), ("users", True)]


def test_temp_candidates_of_a_repeated_id_are_one_row_each(spark, cat):
    named = cat["class"].withColumn("relname", F.when(F.col("oid") == 21, "users_name_ccnew").otherwise(F.col("relname")))
    repeated = {**_repeated(spark, cat), "class": named}
    got = inv.temp_rebuild_candidates(repeated, inv.index_inventory(repeated, kind="all"))
    wanted = [("log_2", "users_name_ccnew", False), ("orders", "orders_a_ccnew", False), ("users", "users_name_ccnew", True)]
    assert rows(got, "table_name", "index_name", "healthy") == wanted
