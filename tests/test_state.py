import datetime as dt

import pytest
from pyspark.sql import functions as F

from indexward import schemas as S
from indexward.operators import state as st
from indexward.plans.maintenance import prepare_run, record_run, resume_worklist
from indexward.sources import append_logbook, drop_old_versions, read_logbook, read_state, state_version, update_state, write_state
from indexward.sources import tables

from conftest import rows

OLD, NOW = dt.datetime(2001, 1, 1), dt.datetime(2002, 1, 1)


def make(spark, *data):
    """data: (index, state, session)"""
    return spark.createDataFrame([("s", "t", i, "btree", state, sid, OLD, OLD) for i, state, sid in data], S.STATE_SCHEMA)


def work(spark, *names, schema="s"):
    return spark.createDataFrame([(schema, "t2", n, "hash", 1) for n in names], "schema_name string, table_name string, index_name string, index_type string, pass int")


COLUMNS = ("index_name", "table_name", "index_type", "state", "session_id", "created_at", "updated_at")


def test_merge_truth_table(spark):
    old = make(
        spark, ("ip_out", "in_progress", "a"), ("ip_in", "in_progress", "a"), ("pend", "pending", "a"), ("fail", "failed", "a"),
        ("odd", "invalid_state", "a"), ("done", "completed", "a"), ("skip", "skipped", None), ("out", "failed", "a"),
        ("done_out", "completed", "a"),
    )
    got = st.state_merge(old, work(spark, "ip_in", "pend", "fail", "odd", "done", "skip", "new"), "b", NOW)
    fresh = ("t2", "hash", "pending", "b")
    assert rows(got, *COLUMNS) == sorted([
        ("ip_out", "t", "btree", "pending", None, OLD, OLD),
        *[(n, *fresh, OLD, NOW) for n in ("ip_in", "pend", "fail", "odd")],
        ("done", "t2", "hash", "completed", "a", OLD, NOW),
        ("skip", "t2", "hash", "skipped", None, OLD, NOW),
        ("out", "t", "btree", "failed", "a", OLD, OLD),
        ("done_out", "t", "btree", "completed", "a", OLD, OLD),
        ("new", *fresh, NOW, NOW),
    ], key=repr)
    assert got.columns == list(S.STATE_SCHEMA.names)


def test_merge_twice_changes_nothing_more(spark):
    old = make(spark, ("a", "in_progress", "x"), ("b", "completed", "x"), ("c", "failed", "x"))
    once = st.state_merge(old, work(spark, "a", "b", "n"), "y", NOW)
    assert rows(st.state_merge(once, work(spark, "a", "b", "n"), "y", NOW)) == rows(once)


def test_merge_of_a_list_with_repeats_keeps_one_row(spark):
    listed = work(spark, "a").unionByName(work(spark, "a").withColumns({"table_name": F.lit("last"), "pass": F.lit(2)}))
    got = st.state_merge(make(spark), listed, "y", NOW, order="pass")
    assert rows(got, "index_name", "table_name") == [("a", "last")]


def test_updates(spark):
    old = make(spark, ("a", "pending", "x"), ("b", "pending", "x"))
    upd = spark.createDataFrame(
        [("s", "a", "failed", 1), ("s", "a", "completed", 2), ("s", "unknown", "failed", 1), ("other", "b", "failed", 1)],
        "schema_name string, index_name string, state string, seq int",
    )
    got = st.apply_states(old, upd, NOW, order="seq")
    assert rows(got, "index_name", "state", "session_id", "updated_at") == [("a", "completed", "x", NOW), ("b", "pending", "x", OLD)]
    claimed = st.claim(old, upd.filter("state = 'completed'"), "y", NOW)
    assert rows(claimed, "index_name", "state", "session_id", "updated_at") == [("a", "in_progress", "y", NOW), ("b", "pending", "x", OLD)]


def test_the_two_resets_differ(spark):
    old = make(spark, ("a", "in_progress", "x"), ("b", "in_progress", "y"), ("c", "in_progress", None), ("d", "failed", "x"))
    got = st.reset_in_progress(old, NOW, "x")
    assert rows(got, "index_name", "state", "session_id", "updated_at") == [
        ("a", "pending", "x", NOW), ("b", "in_progress", "y", OLD), ("c", "in_progress", None, OLD), ("d", "failed", "x", OLD),
    ]
    assert st.reset_count(old, "x").first()[0] == 1 and st.reset_count(old).first()[0] == 3
    merged = st.state_merge(old, work(spark), "z", NOW)
    assert rows(merged, "index_name", "state", "session_id", "updated_at")[0] == ("a", "pending", None, OLD)


def test_pending_covers_all_but_two_states(spark):
    old = make(spark, ("a", "invalid_state", "x"), ("b", "completed", "x"), ("c", "skipped", "x"), ("d", "failed", "y"))
    assert rows(st.load_pending(old, ["s"]), "index_name", "size_bytes", "parent_table_name") == [("a", None, None), ("d", None, None)]
    assert st.load_pending(old, ["s"], "t").count() == 2 and st.load_pending(old, ["s"], "u").count() == 0
    assert st.has_pending(old) and st.has_pending(old, "y") and not st.has_pending(old, "x")
    assert not st.has_pending(old.filter("state <> 'failed'"))
    assert rows(st.pending_flags(old), "session_id", "has_pending") == [("x", False), ("y", True)]
    assert rows(st.state_counts(st.finalize_pending(make(spark, ("a", "pending", "x"), ("b", "failed", "x"))))) == [(0, 0, 0, 1, 1)]


def test_outcomes_map_to_states(spark):
    df = spark.createDataFrame([(o,) for o in (*S.OUTCOMES, "surprise")], "o string")
    got = dict(df.select("o", st.outcome_to_state(F.col("o"))).collect())
    assert got == {
        "success": "completed", "skipped": "skipped", "invalid_index": "skipped", "below_bloat_threshold": "skipped",
        "failed": "failed", "validation_failed": "failed", "excluded": "failed", "surprise": "failed",
    }


def test_completed_tables_are_distinct(spark):
    df = make(spark, ("a", "completed", "x"), ("b", "completed", "x"), ("c", "failed", "x"))
    assert rows(st.completed_tables(df)) == [("s", "t")]


def test_where_a_session_starts(spark):
    old = make(spark, ("a", "failed", "x"), ("b", "completed", "x"))
    inventory = work(spark, "a", "b", "n")
    fresh = resume_worklist(old, inventory, False, "y", NOW, ["s"])
    assert fresh.state.count() == 0 and fresh.worklist.count() == 3
    open_rows = resume_worklist(old, inventory, True, "y", NOW, ["s"])
    assert rows(open_rows.worklist, "index_name") == [("a",)] and rows(open_rows.state) == rows(old)
    # Something open in another schema is enough not to rediscover.
    elsewhere = old.filter("index_name = 'b'").unionByName(make(spark, ("z", "pending", "x")).withColumn("schema_name", F.lit("other")))
    assert resume_worklist(elsewhere, inventory, True, "y", NOW, ["s"]).worklist.count() == 0
    done = resume_worklist(old.filter("index_name = 'b'"), inventory, True, "y", NOW, ["s"])
    assert rows(done.worklist, "index_name") == [("a",), ("n",)]
    assert rows(done.state, "index_name", "state") == [("a", "pending"), ("b", "completed"), ("n", "pending")]


def test_clearing(spark):
    both = make(spark, ("a", "failed", "x")).unionByName(make(spark, ("a", "failed", "x")).withColumn("schema_name", F.lit("o")))
    assert rows(st.clear_schemas(both, ["s"]), "schema_name") == [("o",)]
    assert rows(st.clear_schemas(both, spark.createDataFrame([("o",)], "schema_name string")), "schema_name") == [("s",)]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "state")
    assert read_state(spark, path).count() == 0 and state_version(spark, path) == (0, None)
    first = make(spark, ("a", "in_progress", "x"))
    assert write_state(first, path, "run:1") == 1
    # The version that is replaced is read while its successor is written.
    assert write_state(st.reset_in_progress(read_state(spark, path), NOW), path) == 2
    assert rows(read_state(spark, path), "state") == [("pending",)]
    assert state_version(spark, path, "run:1")[0] == 1 and state_version(spark, path, "run:2") == (0, None)
    assert read_state(spark, path).schema == S.STATE_SCHEMA


def test_a_version_without_its_mark_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "state")
    write_state(make(spark, ("a", "failed", "x")), path)
    make(spark, ("b", "failed", "x")).write.parquet(f"{path}/data/000000000002-half")
    assert rows(read_state(spark, path), "index_name") == [("a",)]


def test_logbook(spark, tmp_path):
    path = str(tmp_path / "logbook")
    assert read_logbook(spark, path).count() == 0
    df = spark.createDataFrame([("s", "a", "all", None, "excluded", None, None, None, None), ("s", "b", "all", OLD, "success", 4, 2, 50.0, 1.5)], S.LOGBOOK_SCHEMA)
    append_logbook(df, path, NOW)
    append_logbook(df.filter("index_name = 'a'").drop("reindex_time"), path, NOW)
    got = read_logbook(spark, path)
    assert rows(got, "index_name", "reindex_time") == [("a", NOW), ("a", NOW), ("b", OLD)]
    assert dict(got.dtypes)["size_change"] == "float"
    assert {r[0].isoformat() for r in got.select("reindex_date").distinct().collect()} == {"2001-01-01", "2002-01-01"}


def test_a_whole_run(spark, cat):
    run = prepare_run(cat, S.empty_state(spark), ["shop", "audit"], "one", NOW, kind="all", excluded=["users_gin"], include_partitions=True, threads=3)
    listed = {r.index_name: r for r in run.worklist.collect()}
    assert set(listed) == {"users_name", "log_1_idx", "log_2_idx"} and run.worklist.count() == 4
    assert listed["log_2_idx"].parent_table_name == "log"
    # The excluded index is logged, but has no row in the state of a fresh run.
    assert rows(run.excluded, "index_name", "reindex_status") == [("users_gin", "excluded")]
    assert rows(run.state, "index_name", "state") == [("log_1_idx", "pending"), ("log_2_idx", "pending"), ("users_name", "pending"), ("users_name", "pending")]
    ids = [r.index_oid for r in run.worklist.collect()]
    attempts = spark.createDataFrame([(i, 0, NOW, 10, None) for i in ids], S.ATTEMPTS)
    after = spark.createDataFrame([(i, 1 << 20, True) for i in ids], "index_oid bigint, after_size bigint, healthy_after boolean")
    gates = spark.createDataFrame([(None,)], "skip_reason string")
    done = record_run(cat, run.state, run.worklist, after, gates, attempts, "all", NOW)
    assert {r.state for r in done.state.collect()} == {"completed"}
    assert {(r.index_type, r.reindex_status) for r in done.logbook.collect()} == {("all", "success")}
    assert done.logbook.columns == list(S.LOGBOOK_SCHEMA.names)
    again = prepare_run(cat, done.state, ["shop", "audit"], "two", NOW, resume=True, kind="all", include_partitions=True)
    assert {r.index_name for r in again.worklist.collect()} == {"users_gin"}


def test_old_versions_are_removed(spark, tmp_path):
    path = str(tmp_path / "state")
    assert drop_old_versions(spark, path) == 0
    for name in "abc":
        write_state(make(spark, (name, "failed", "x")), path)
    assert drop_old_versions(spark, path, keep=1) == 2 and drop_old_versions(spark, path, keep=1) == 0
    assert rows(read_state(spark, path), "index_name") == [("c",)]
    assert write_state(make(spark, ("d", "failed", "x")), path) == 4


def test_fleet_keys_must_agree(spark):
    fleet = S.empty_state(spark, ["instance_id", "database_name"])
    assert fleet.columns[:2] == ["instance_id", "database_name"] and S.empty_state(spark).schema == S.STATE_SCHEMA
    listed = spark.createDataFrame(
        [(1, "a", "s", "t", "i", "btree"), (2, "a", "s", "t", "i", "btree")],
        "instance_id bigint, database_name string, schema_name string, table_name string, index_name string, index_type string",
    )
    assert st.state_merge(fleet, listed, "x", NOW).count() == 2
    for call in (
        lambda: st.state_merge(S.empty_state(spark), listed, "x", NOW),
        lambda: st.claim(S.empty_state(spark), listed, "x", NOW),
        lambda: st.apply_states(S.empty_state(spark), listed.withColumn("state", F.lit("failed")), NOW),
    ):
        with pytest.raises(ValueError):
            call()


def test_each_instance_resumes_by_itself(spark):
    listed = spark.createDataFrame(
        [(i, "s", "t", f"i{n}", "btree") for i in (1, 2) for n in (1, 2)],
        "instance_id bigint, schema_name string, table_name string, index_name string, index_type string",
    )
    old = st.state_merge(S.empty_state(spark, ["instance_id"]), listed.filter("instance_id = 1 AND index_name = 'i1'"), "x", NOW)
    resumed = resume_worklist(old, listed, True, "y", NOW, ["s"])
    assert rows(resumed.worklist, "instance_id", "index_name") == [(1, "i1"), (2, "i1"), (2, "i2")]


def test_a_stored_row_without_state_keeps_its_creation(spark):
    earlier = dt.datetime(2000, 1, 1)
    old = spark.createDataFrame([("s", "t", "i", "btree", None, None, earlier, earlier)], S.STATE_SCHEMA)
    listed = old.select("schema_name", "table_name", "index_name", "index_type")
    assert st.state_merge(old, listed, "x", NOW).first()["created_at"] == earlier


def data_files(path):
    return {str(f) for f in path.rglob("*.parquet") if "data" in f.parts}


def test_a_small_change_rewrites_only_the_part_it_touches(spark, tmp_path):
    path = str(tmp_path / "state")
    names = [f"i{n}" for n in range(300)]
    write_state(make(spark, *[(n, "pending", "x") for n in names]), path, parts=40)
    before = data_files(tmp_path)
    assert len(before) >= 40 and state_version(spark, path)[0] == 1
    one = make(spark, ("i7", "completed", "x")).select("schema_name", "index_name", "state")
    assert update_state(spark, path, one, lambda r: st.apply_states(r, one, NOW), "job:1") == 2
    after = data_files(tmp_path)
    assert len(after - before) == len(before - after) == 1 and len(after) == len(before)
    assert not list((tmp_path / "state" / "staged").iterdir())
    assert rows(read_state(spark, path).filter("state <> 'pending'"), "index_name", "state") == [("i7", "completed")]
    assert read_state(spark, path).count() == 300 and read_state(spark, path).schema == S.STATE_SCHEMA
    # The same source again changes nothing, not even files.
    assert update_state(spark, path, one, lambda r: r.limit(0), "job:1") == 0
    assert data_files(tmp_path) == after and state_version(spark, path)[0] == 2


def test_an_interrupted_change_is_read_and_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "state")
    write_state(make(spark, ("a", "pending", "x"), ("b", "pending", "x"), ("c", "pending", "x")), path, parts=4)
    one = make(spark, ("a", "completed", "x")).select("schema_name", "index_name", "state")
    with monkeypatch.context() as lost:
        def stop(*_):
            raise RuntimeError("lost")

        lost.setattr(tables, "_finish", lambda spark, path, line: stop() if line.staged else None)
        with pytest.raises(RuntimeError):
            update_state(spark, path, one, lambda r: st.apply_states(r, one, NOW), "job:1")
    want = [("a", "completed"), ("b", "pending"), ("c", "pending")]
    assert rows(read_state(spark, path), "index_name", "state") == want
    # The batch is delivered again: it is finished, not applied twice.
    assert update_state(spark, path, one, lambda r: r.limit(0), "job:1") == 0
    assert rows(read_state(spark, path), "index_name", "state") == want
    assert not list((tmp_path / "state" / "staged").iterdir())


def test_writers_in_place(spark, tmp_path):
    path = str(tmp_path / "state")
    write_state(S.empty_state(spark), path)
    assert read_state(spark, path).count() == 0
    listed = make(spark, ("a", "x", "x"), ("b", "x", "x"), ("c", "x", "x")).select("schema_name", "table_name", "index_name", "index_type")
    update_state(spark, path, listed, lambda r: st.state_merge(r, listed, "one", NOW))
    update_state(spark, path, listed.filter("index_name = 'b'"), lambda r: st.claim(r, listed.filter("index_name = 'b'"), "two", NOW))
    assert rows(read_state(spark, path), "index_name", "state", "session_id") == [("a", "pending", "one"), ("b", "in_progress", "two"), ("c", "pending", "one")]
    update_state(spark, path, lambda r: r.filter(st.is_stuck()), lambda r: st.reset_in_progress(r, NOW))
    assert rows(read_state(spark, path), "state") == [("pending",)] * 3
    update_state(spark, path, lambda r: r, lambda r: st.clear_schemas(r, ["s"]))
    assert read_state(spark, path).count() == 0 and state_version(spark, path)[0] == 5
    assert update_state(spark, path, listed.limit(0), lambda r: r) == 6
    with pytest.raises(ValueError):
        update_state(spark, str(tmp_path / "none"), listed, lambda r: r)


def test_keys_of_a_fleet_meet_their_part_whatever_their_type(spark, tmp_path):
    path = str(tmp_path / "state")
    fleet = make(spark, *[(f"i{n}", "pending", "x") for n in range(40)]).withColumn("instance_id", F.lit(3).cast("bigint"))
    write_state(fleet, path, parts=16)
    done = fleet.filter("index_name < 'i2'").select(F.col("instance_id").cast("int").alias("instance_id"), "schema_name", "index_name", F.lit("failed").alias("state"))
    update_state(spark, path, done, lambda r: st.apply_states(r, done, NOW))
    assert read_state(spark, path, ["instance_id"]).filter("state = 'failed'").count() == done.count() == 12
    with pytest.raises(ValueError):
        update_state(spark, path, done.drop("instance_id"), lambda r: r)


def test_the_log_of_versions_stays_short(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "LOG_FILES", 5)
    path = str(tmp_path / "state")
    write_state(make(spark, ("a", "pending", "x")), path, parts=2)
    one = make(spark, ("a", "failed", "x")).select("schema_name", "index_name", "state")
    for batch in range(6):
        assert update_state(spark, path, one, lambda r: st.apply_states(r, one, NOW), f"stream:{batch}") == batch + 2
        assert len(list((tmp_path / "state" / "versions").glob("part-*"))) <= 7
    assert update_state(spark, path, one, lambda r: r.limit(0), "stream:5") == 0
    assert state_version(spark, path)[0] == 7 and rows(read_state(spark, path), "state") == [("failed",)]


def test_a_run_that_is_appended_again_counts_once(spark, tmp_path):
    path = str(tmp_path / "logbook")
    df = spark.createDataFrame([("s", n, "all", None, "success", 4, 2, 50.0, 1.5) for n in "abc"], S.LOGBOOK_SCHEMA).drop("reindex_time")
    append_logbook(df, path, OLD, "2001")
    append_logbook(df.filter("index_name <> 'c'"), path, NOW, "2001")
    append_logbook(df.filter("index_name = 'a'"), path, NOW, "2002")
    append_logbook(df.filter("index_name = 'b'"), path, NOW)
    got = read_logbook(spark, path, with_run=True)
    assert rows(got, "index_name", "reindex_time") == [("a", NOW), ("a", NOW), ("b", NOW), ("b", NOW)]
    assert {("a", "2001"), ("b", "2001"), ("a", "2002")} <= set(rows(got, "index_name", "run_id"))
    assert "run_id" not in read_logbook(spark, path).columns
    with pytest.raises(ValueError):
        append_logbook(df, path, NOW, "a/b")
