"""What a query derives and shuffles stays bounded by what it needs."""

import datetime as dt
import gzip
import importlib
import json

import pytest
from pyspark.sql import functions as F

from indexward import schemas as S
from indexward.operators import inventory as inv
from indexward.operators import outcome, ranking, state
from indexward.plans import maintenance, ranked_plan
from indexward.sources import bindings, plan_files

from conftest import rows

queries = importlib.import_module("indexward.checks.queries")
FOLDER = "/root/testdata/sf0.001"
NOW = dt.datetime(2002, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def written(monkeypatch):
    """The stored views that are asked for; the original still writes them."""
    names, store = [], bindings.materialize_once

    def noted(spark, key, label, build):
        names.append(label)
        return store(spark, key, label, build)

    monkeypatch.setattr(bindings, "materialize_once", noted)
    return names


def test_partitioned_tables_store_nothing(spark, written):
    assert queries.queries()["partitioned_tables"](spark, FOLDER).count() > 0 and written == []


def test_inventories_store_no_statistics(spark, written):
    queries.queries()["inv_all"](spark, FOLDER)
    assert "cat_class" in written and "cat_stat_index" not in written


def test_indexes_are_left_out_of_the_table_side(cat):
    kinds = {r[0] for r in inv._not_indexes(cat["class"]).select("relkind").collect()}
    assert "i" not in kinds and {"r", "p"} <= kinds
    unknown = cat["class"].withColumn("relkind", F.lit(None).cast("string"))
    assert inv._not_indexes(unknown).count() == unknown.count()


def test_within_ids_keeps_what_a_join_needs(cat):
    worklist = cat["class"].filter("oid IN (21, 24)").select(F.col("oid").alias("index_oid"))
    assert [r.oid for r in inv.within_ids(cat["class"], "oid", worklist, "index_oid").orderBy("oid").collect()] == [21, 22, 23, 24]
    assert inv.within_ids(cat["class"], "oid", worklist.limit(0), "index_oid").isEmpty()


def test_rows_are_numbered_without_columns_that_are_not_returned(spark, monkeypatch):
    seen, number = [], queries.ranking.number_rows
    monkeypatch.setattr(queries.ranking, "number_rows", lambda df, order: (seen.append(df.columns), number(df, order))[1])
    queries.queries()["order_size_desc"](spark, FOLDER)
    assert set(seen[0]) == {"schema_ord", "schema_name", "index_name", "size_bytes"}


def test_updates_of_the_state_are_derived_once(spark, monkeypatch):
    labels, store = [], queries.materialize
    monkeypatch.setattr(queries, "materialize", lambda df, label: (labels.append(label), store(df, label))[1])
    queries.queries()["state_in_place"](spark, FOLDER)
    assert labels == ["updates"]


@pytest.fixture
def nothing_known(monkeypatch):
    """What earlier tests of the session have stored is not read."""
    monkeypatch.setattr(bindings, "written", lambda *key: None)


def test_one_pass_over_a_large_input_stores_nothing(spark, written, nothing_known, monkeypatch):
    for name in ("inv_all", "state_merge", "page_drift_bloat"):
        run = queries.queries()[name]
        stored = rows(run(spark, FOLDER))
        assert "cat_class" in written and stored
        written.clear()
        with monkeypatch.context() as large:
            large.setattr(bindings, "SMALL_INPUT", 0)
            assert rows(run(spark, FOLDER)) == stored and written == []


def test_what_is_stored_already_is_read(spark, written):
    bindings.bind_catalog(spark, FOLDER, "class")
    written.clear()
    files = bindings.bind_catalog(spark, FOLDER, "class", stored=())["class"].inputFiles()
    assert files and all("/cat_class-" in f for f in files) and written == []


def test_runs_store_nothing_of_the_catalog(spark, written, nothing_known):
    for name in ("recorded_state", "logbook_append", "logbook_rerun"):
        assert queries.queries()[name](spark, FOLDER).count() > 0 and written == []


def test_partitions_and_runs_look_up_tables_by_the_range_of_their_ids(cat, monkeypatch):
    cut, within = [], inv.within_ids

    def noted(rows, column, ids, id_column):
        kept = within(rows, column, ids, id_column)
        cut.append((column, id_column, rows.count() - kept.count()))
        return kept

    monkeypatch.setattr(inv, "within_ids", noted)
    assert rows(inv.table_partitions(cat), "partition_name") == [("log_1",), ("log_2",)]
    assert [c for c in cut if c[:2] == ("oid", "inhrelid") and c[2] > 0]
    cut.clear()
    worklist = cat["class"].filter("oid IN (25, 26)").select(F.col("oid").alias("index_oid"))
    assert rows(inv.before_snapshot(cat, worklist), "index_oid") == [(25,), (26,)]
    assert [c for c in cut if c[:2] == ("oid", "indrelid") and c[2] > 0]


def test_the_catalog_of_some_names_is_enough_for_their_inventory(cat):
    for names in (["users_name", "log_1_idx", "users_pk", "none"], ["none"], []):
        part = inv.named_catalog(cat, names)
        for kind in ("all", "constraint"):
            whole = inv.index_inventory(cat, kind=kind).filter(F.col("index_name").isin(names))
            assert rows(inv.index_inventory(part, kind=kind)) == rows(whole)
    part = inv.named_catalog(cat, ["users_name"])
    assert rows(part["index"], "indexrelid") == [(21,), (24,)] and rows(part["class"], "oid") == [(10,), (12,), (21,), (24,)]


def test_the_catalog_of_some_names_keeps_databases_apart_and_copies(cat):
    fleet = {k: df.withColumn("database_name", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("b")))) for k, df in cat.items()}
    fleet["class"] = fleet["class"].filter("database_name = 'b' OR relname <> 'log_1_idx'")
    want = rows(inv.index_inventory(fleet, kind="all").filter("index_name IN ('log_1_idx', 'users_name')"))
    assert want and rows(inv.index_inventory(inv.named_catalog(fleet, ["log_1_idx", "users_name"]), kind="all")) == want


@pytest.fixture
def run(spark, cat):
    """Observations of a run: index 24 is stopped by the gate of its instance, 22 is not healthy, 99 is unknown, 26 listed twice."""
    work = inv.index_relations(cat).filter("index_oid IN (20, 21, 22, 24, 25, 26)").select("schema_name", "table_name", "index_name", "index_oid", "index_type")
    work = work.unionByName(work.filter("index_oid = 26")).unionByName(work.filter("index_oid = 25").withColumn("index_oid", F.lit(99).cast("bigint")))
    work = work.withColumn("instance_id", F.when(F.col("index_oid") == 24, 1).otherwise(2).cast("bigint"))
    after = spark.createDataFrame([(i, 100, i != 25) for i in (20, 21, 22, 24, 24, 25, 26, 26)], "index_oid bigint, after_size bigint, healthy_after boolean")
    checked = spark.createDataFrame([(1, "active vacuum"), (2, None)], "instance_id bigint, skip_reason string")
    start = dt.datetime(2002, 1, 1)
    tries = spark.createDataFrame([(i, 0, start, 10, "permission denied" if i == 20 else None) for i in (20, 22, 23, 24, 25, 26)], S.ATTEMPTS)
    return cat, work, after, checked, tries


def _expected(cat, work, after, checked, tries, keys=()):
    return rows(outcome.outcome_records(work, inv.before_snapshot(cat, work), after, checked, tries, keys=keys))


def test_outcomes_of_a_run_are_those_of_its_records(run, monkeypatch):
    want = _expected(*run)
    assert {r[5] for r in want} == {None, "failed", "invalid_index", "skipped", "success", "validation_failed"}
    assert len([r for r in want if r[1] == 24]) == 2 and len([r for r in want if r[1] == 26]) == 4
    assert rows(maintenance.run_outcomes(*run, keys=())) == want
    monkeypatch.setattr(maintenance, "MAX_BROADCAST_IDS", 0)
    assert rows(maintenance.run_outcomes(*run, keys=())) == want


def test_attempts_are_looked_up_for_what_the_gates_let_through(run, monkeypatch):
    looked, fold = [], outcome.fold_attempts
    monkeypatch.setattr(maintenance, "fold_attempts", lambda tries, **how: (looked.append(rows(tries, "index_oid")), fold(tries, **how))[1], raising=False)
    maintenance.run_outcomes(*run, keys=())
    assert looked == [[(20,), (25,), (26,)]]
    looked.clear()
    none = run[3].withColumn("skip_reason", F.lit("active vacuum"))
    assert {r.reindex_status for r in maintenance.run_outcomes(*run[:3], none, run[4], keys=()).collect()} == {None, "invalid_index", "skipped"}
    assert looked == [[]]


def test_attempts_with_leading_keys_that_tell_no_ids_apart_are_kept(run):
    tries = run[4].withColumn("instance_id", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))))
    want = _expected(*run[:4], tries)
    assert len([r for r in want if r[1] == 24]) == 4
    assert rows(maintenance.run_outcomes(*run[:4], tries, keys=())) == want


def test_runs_store_only_what_outcomes_take_from_their_list(run, monkeypatch):
    stored, store = {}, maintenance.materialize
    monkeypatch.setattr(maintenance, "materialize", lambda df, label: (stored.update({label: df.columns}), store(df, label))[1])
    maintenance.run_outcomes(*run, keys=())
    assert stored["worklist"] == ["instance_id", "index_oid", "schema_name", "table_name", "index_name"]
    cat, work, *rest = run
    got = maintenance.run_outcomes(cat, work.drop("table_name"), *rest, keys=())
    assert stored["worklist"] == ["instance_id", "index_oid", "schema_name", "index_name"] and "table_name" not in got.columns
    whole = maintenance.run_outcomes(*run, keys=())
    assert rows(got) == rows(whole.drop("table_name"))


def test_a_list_that_fills_its_range_of_ids_is_looked_up_by_the_range(cat, monkeypatch):
    assert inv._fills_range(cat["class"].filter("oid IN (21, 24)"), "oid") and not inv._fills_range(cat["class"].filter("oid IN (20, 24)"), "oid")
    assert not inv._fills_range(cat["class"].limit(0), "oid")
    work = cat["class"].filter("oid IN (21, 24)").select(F.col("oid").alias("index_oid"))
    exact, near = inv.before_snapshot(cat, work), inv.before_snapshot(cat, work, exact=False)
    assert rows(exact, "index_oid") == [(21,), (24,)] and rows(near, "index_oid") == [(21,), (22,), (23,), (24,)]
    assert rows(near.filter("index_oid IN (21, 24)")) == rows(exact)
    sparse = cat["class"].filter("oid IN (20, 24)").select(F.col("oid").alias("index_oid"))
    assert rows(inv.before_snapshot(cat, sparse, exact=False)) == rows(inv.before_snapshot(cat, sparse))
    fleet = {k: df.withColumn("instance_id", F.explode(F.array(F.lit(1), F.lit(2)))) for k, df in cat.items()}
    one = work.withColumn("instance_id", F.lit(1))
    assert rows(inv.before_snapshot(fleet, one, exact=False)) == rows(inv.before_snapshot(fleet, one)) != []


def test_plans_of_a_large_input_store_only_the_pairs(spark, written, nothing_known, monkeypatch):
    dealt, store = [], bindings.materialize_once_by
    monkeypatch.setattr(bindings, "materialize_once_by", lambda *a: (dealt.append(a[2]), store(*a))[1])
    run = queries.queries()["plan_size"]
    stored = rows(run(spark, FOLDER))
    assert "cat_class" in written and dealt == []
    written.clear()
    monkeypatch.setattr(bindings, "SMALL_INPUT", 0)
    assert rows(run(spark, FOLDER + "/.")) == stored and written == [] and dealt == ["li_pair"]


def test_pairs_are_dealt_by_part_unless_one_part_is_hot(spark, written, nothing_known, monkeypatch):
    monkeypatch.setattr(bindings, "SMALL_INPUT", 0)
    elsewhere = FOLDER + "/./."
    dealt = bindings.bind(spark, elsewhere, "li_pair", stored=("li_pair",))["li_pair"]
    plan = dealt.groupBy("l_partkey").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and written == []
    monkeypatch.setattr(bindings, "HOT_KEY_ROWS", 0)
    assert rows(bindings.bind(spark, elsewhere + "/.", "li_pair", stored=("li_pair",))["li_pair"]) == rows(dealt)
    assert written == ["li_pair"]


def test_a_plan_shuffles_and_stores_no_texts_that_it_can_make_again(cat, monkeypatch):
    kept, store = [], ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df, label: (kept.append((label, df.columns)), store(df, label))[1])
    want = rows(ranking.rank_plan(ranking.plan_inventory(cat), "size", NOW))
    assert {"size_pretty", "last_scan", "last_scan_epoch"} <= set(kept.pop()[1])
    got = ranking.rank_plan(ranking.plan_facts(cat), "size", NOW)
    assert rows(got) == want and got.columns == ranking.rank_plan(ranking.plan_inventory(cat), "size", NOW).columns
    assert not {"size_pretty", "last_scan", "last_scan_epoch"} & set(kept[0][1])
    for criteria in ("age", "bloat,size,scan-frequency,age"):
        for never in ("code", "documented"):
            wide = ranking.rank_plan(ranking.plan_inventory(cat), criteria, NOW, never)
            assert rows(ranking.rank_plan(ranking.plan_facts(cat), criteria, NOW, never)) == rows(wide)
    fleet = {name: df.withColumn("instance_id", F.lit(1)) for name, df in cat.items()}
    assert rows(ranking.rank_plan(ranking.plan_facts(fleet), "age,size", NOW)) == rows(ranking.rank_plan(ranking.plan_inventory(fleet), "age,size", NOW))


def test_plan_files_are_written_as_they_were_numbered(spark, cat, tmp_path, monkeypatch):
    monkeypatch.setattr(ranked_plan, "write_plan", lambda plan, *a, **k: (plans.append(plan), write(plan, *a, **k)))
    plans, write = [], plan_files.write_plan
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        ranked_plan.write_ranked_plan(cat, f"{tmp_path}/plan", None, "size", NOW, compression="gzip")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "Exchange" not in plans[0]._jdf.queryExecution().executedPlan().toString()
    files = sorted(tmp_path.glob("plan/part-*.json.gz"))
    ranks = [json.loads(line)["rank"] for f in files for line in gzip.open(f, "rt")]
    assert len(files) > 1 and ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 6


def test_a_list_with_repeats_is_merged_by_one_shuffle_of_its_rows(spark):
    layout = "schema_name string, index_name string, table_name string, index_type string, pass int"
    listed = [("s", "a", "t", "btree", 0), ("s", "a", "u", "gin", 1), ("s", "b", "t", "btree", 0), ("s", None, "t", "gin", 0), ("s", "c", "t", "gin", None)]
    merged = state.state_merge(S.empty_state(spark), spark.createDataFrame(listed, layout).repartition(3), "x", NOW, order="pass")
    assert rows(merged, "index_name", "table_name", "index_type") == [("a", "u", "gin"), ("b", "t", "btree")]
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_keys_of_the_integrity_check_are_derived_once_and_names_not_written_if_many(spark, cat, monkeypatch):
    labels, store = [], inv.materialize
    for module in (queries, inv):
        monkeypatch.setattr(module, "materialize", lambda df, label: (labels.append(label), store(df, label))[1])
    want = rows(queries.queries()["integrity"](spark, FOLDER))
    assert labels == ["integrity-keys", "index-names"]
    monkeypatch.setattr(inv, "MAX_BROADCAST_NAMES", 100)
    labels.clear()
    assert rows(queries.queries()["integrity"](spark, FOLDER)) == want and labels == ["integrity-keys"]


def test_b_tree_inventories_drop_other_methods_where_classes_are_scanned(cat, monkeypatch):
    kept = inv._of_method(cat, "btree")["class"]
    assert {r.relam for r in kept.filter("relkind = 'i'").select("relam").collect()} == {1}
    assert kept.filter("relkind <> 'i'").count() == cat["class"].filter("relkind <> 'i'").count()
    want = rows(inv.index_inventory(cat, kind="btree"))
    monkeypatch.setattr(inv, "MAX_METHOD_IDS", 0)
    assert inv._of_method(cat, "btree") is cat and rows(inv.index_inventory(cat, kind="btree")) == want
