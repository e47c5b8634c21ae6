import datetime as dt

import pytest
from pyspark.sql import functions as F

from indexward import schemas as S
from indexward.operators import gates, outcome
from indexward.operators.latest import last_per_key

from conftest import rows

T0 = dt.datetime(2002, 1, 1)
DEADLOCK, DENIED = "deadlock detected", "permission denied"


def attempts(spark, *data):
    """data: (index, attempt, start second, duration, error)"""
    return spark.createDataFrame([(i, a, T0 + dt.timedelta(seconds=s), d, e) for i, a, s, d, e in data], S.ATTEMPTS)


def test_attempts(spark):
    got = outcome.fold_attempts(attempts(
        spark,
        (1, 0, 0, 5, None),
        (2, 0, 0, 5, DEADLOCK), (2, 1, 15, 4, "connection reset"), (2, 2, 29, 7, None),
        (3, 0, 0, 5, DENIED), (3, 1, 20, 5, None),
        *[(4, a, a * 20, 3, DEADLOCK) for a in range(4)],
        (5, 0, 0, 5, DEADLOCK), (5, 1, 15, 5, DEADLOCK),
        (6, 0, 0, 5, DEADLOCK), (6, 1, 15, 2, DENIED), (6, 2, 40, 2, None),
    ))
    assert rows(got, "index_oid", "outcome", "attempts_used", "error", "duration_secs") == [
        (1, "ok", 1, None, 5.0), (2, "ok", 3, None, 36.0), (3, "failed", 1, DENIED, 5.0), (4, "failed", 4, DEADLOCK, 63.0),
        (5, "incomplete", 2, None, None), (6, "failed", 2, DENIED, 17.0),
    ]


@pytest.fixture
def observed(spark):
    names = "gone sick thin blocked refused lost broken good running odd".split()
    work = spark.createDataFrame([(i, "s", "t", n, 1 if n == "blocked" else 2) for i, n in enumerate(names)], "index_oid bigint, schema_name string, table_name string, index_name string, instance_id bigint")
    before = spark.createDataFrame(
        [(i, 300, n != "sick", 4.99 if n == "thin" else 5.0) for i, n in enumerate(names) if n != "gone"],
        "index_oid bigint, before_size bigint, healthy_before boolean, bloat_percentage double",
    )
    after = spark.createDataFrame(
        [(i, 200, None if n == "odd" else n != "broken") for i, n in enumerate(names) if n != "lost"],
        "index_oid bigint, after_size bigint, healthy_after boolean",
    )
    checked = spark.createDataFrame([(1, "active vacuum"), (2, None)], "instance_id bigint, skip_reason string")
    tries = attempts(spark, *[(i, 0, 0, 10, DENIED if n == "refused" else None) for i, n in enumerate(names) if n != "running"])
    return work, before, after, checked, tries


def test_first_rule_wins(spark, observed):
    got = outcome.outcome_records(*observed, bloat_threshold=5, keys=())
    third = (300 - 200) / 300 * 100
    as_real = spark.range(1).select(F.lit(third).cast("float")).first()[0]
    rounded = spark.range(1).select(F.lit(33.3).cast("float")).first()[0]
    assert {r.index_name: (r.reindex_status, r.state, r.before_size, r.after_size, r.size_change, r.reindex_duration) for r in got.collect()} == {
        "gone": (None, "failed", None, None, None, None),
        "sick": ("invalid_index", "skipped", None, None, None, None),
        "thin": ("below_bloat_threshold", "skipped", None, None, None, None),
        "blocked": ("skipped", "skipped", None, None, None, None),
        "refused": ("failed", "failed", 300, None, None, 10.0),
        "lost": (None, "failed", None, None, None, None),
        "broken": ("validation_failed", "failed", 300, 200, rounded, 10.0),
        "good": ("success", "completed", 300, 200, as_real, 10.0),
        "running": (None, None, None, None, None, None),
        "odd": ("validation_failed", "failed", 300, 200, rounded, 10.0),
    }


def test_no_threshold_lets_all_pass(spark, observed):
    got = {r.index_name: r.reindex_status for r in outcome.outcome_records(*observed, keys=()).collect()}
    assert got["thin"] == "success"


def test_logbook_and_state_rows(spark, observed):
    got = outcome.outcome_records(*observed, bloat_threshold=5, keys=())
    log = outcome.logbook_rows(got, "BTREE", T0)
    assert log.count() == 7 and {r.index_type for r in log.collect()} == {"btree"}
    states = outcome.outcome_states(got)
    assert states.count() == 9 and "running" not in {r.index_name for r in states.collect()}
    report = {r.reindex_status: r for r in outcome.logbook_report(log).collect()}
    assert (report["success"].bytes_reclaimed, report["success"].mean_duration) == (100, 10.0)
    assert report["validation_failed"].n_indexes == 2 and report["skipped"].bytes_before is None
    events = outcome.outcome_events(got, T0)
    assert rows(events, "level", "status") == [("ERROR", "failed"), ("ERROR", "validation_failed"), ("ERROR", "validation_failed"), ("SUCCESS", "success")]
    assert outcome.failure_report(events).count() == 3


def test_preflight(spark):
    activity = spark.createDataFrame(
        [(1, 7, "active", "VACUUM x"), (2, 8, "idle", "vacuum x"), (3, 9, "active", "autovacuum: VACUUM x"), (4, 1, "active", None)], S.ACTIVITY
    )
    slots = spark.createDataFrame([(1, "a", False), (2, "b", True), (5, "c", False)], S.SLOTS)
    repl = spark.createDataFrame([(1, "r", T0, "0/1", None, "sync"), (6, "r", T0, "0/1", None, "quorum")], S.REPLICATION)
    checked = gates.preflight_gates(activity, slots, repl)
    got = {r.instance_id: r.skip_reason for r in gates.preflight_reason(checked).collect()}
    assert got == {
        1: "active vacuum, inactive replication slots, sync replication connection", 2: None, 3: None, 4: None,
        5: "inactive replication slots", 6: None,
    }
    got = {r.instance_id: r.skip_reason for r in gates.preflight_reason(checked, True, False, True).collect()}
    assert got[1] == "inactive replication slots"
    got = {r.instance_id: r.skip_reason for r in gates.preflight_reason(checked, True, True, True).collect()}
    assert set(got.values()) == {None}
    own = gates.preflight_gates(activity, slots, repl, own_pid=7)
    assert rows(own.filter("instance_id = 1"), "active_vacuum") == [(False,)]


def test_lag(spark):
    repl = spark.createDataFrame(
        [(1, "a", T0, "0/20", "0/10", "async"), (1, "b", T0, "1/0", "0/FFFFFFFF", "async"), (2, "a", T0, "0/20", None, "async")], S.REPLICATION
    )
    assert rows(gates.max_replica_lag(repl), "instance_id", "max_lag_bytes") == [(1, 16), (2, 0)]
    known = spark.createDataFrame([(1, T0), (3, T0)], "instance_id bigint, ts timestamp")
    assert rows(gates.max_replica_lag(repl, known), "instance_id", "max_lag_bytes") == [(1, 16), (3, 0)]


def test_settings(spark):
    data = [(1, "max_parallel_workers", "8"), (1, "temp_file_limit", "-1"), (1, "maintenance_io_concurrency", "512"), (2, "max_parallel_workers", "7"), (2, "temp_file_limit", "100"), (2, "maintenance_io_concurrency", "513"), (3, "max_parallel_workers", "on")]
    df = spark.createDataFrame(data, S.SETTINGS)
    columns = ("instance_id", "total_workers_ok", "maintenance_workers_ok", "io_concurrency_ok", "temp_file_unlimited")
    assert rows(gates.settings_audit(df, 4, 0), *columns) == [(1, True, True, True, True), (2, False, True, False, False), (3, None, None, None, None)]
    assert rows(gates.settings_audit(df, 2, 3), *columns)[:2] == [(1, True, True, True, True), (2, True, False, False, False)]


def test_analyze_targets(spark):
    names = spark.createDataFrame(
        [("t1", 1), (" a . x.y ", 2), (".t", 3), ("a.", 4), ("t1", 5), ("t2", 6), (" ", 7)], "target string, target_ord int"
    )
    completed = spark.createDataFrame([("a", "t1"), ("b", "t1"), ("a", "x.y")], "schema_name string, table_name string")
    tables = spark.createDataFrame([("a", "t1"), ("a", "x.y"), ("a", "t2")], "schema_name string, table_name string")
    got = outcome.analyze_targets(names, ["a", "b"], completed, tables)
    once = [("a", "t1", "run"), ("b", "t1", "missing")]
    assert rows(got, "target_ord", "schema_name", "table_name", "action") == [
        (1, *once[0]), (1, *once[1]), (2, "a", "x.y", "run"), (5, *once[0]), (5, *once[1]), (6, "a", "t2", "not_reindexed"), (6, "b", "t2", "not_reindexed"),
    ]


def test_summary(spark):
    df = spark.createDataFrame([("pending",), ("failed",), ("completed",), ("completed",), ("skipped",), ("in_progress",)], "state string")
    got = outcome.run_summary(df, T0, T0 + dt.timedelta(seconds=90, milliseconds=500), 4)
    assert rows(got) == [(6, 1, 2, 2, 90.5, 4)]
    event = outcome.summary_events(got, T0).first()
    assert event.message == "Reindexing completed: 6 total indexes processed, 1 failed, Duration: 90.50s (using 4 threads)"


def test_leading_keys_are_named_or_the_same(spark, observed):
    with pytest.raises(ValueError):
        outcome.outcome_records(*observed)
    work, *parts, tries = observed
    before, after, checked = parts
    here = lambda df, *i: df.withColumn("instance_id", F.explode(F.array(*[F.lit(n).cast("bigint") for n in i])))
    # Two instances with the same index ids: each has the sizes of its own.
    both = here(work.drop("instance_id"), 1, 2)
    sizes = here(before, 1, 2).withColumn("before_size", F.col("before_size") + F.col("instance_id"))
    got = outcome.outcome_records(both, sizes, here(after, 1, 2), checked, here(tries, 1, 2)).filter("index_name = 'good'")
    assert rows(got, "instance_id", "reindex_status", "before_size") == [(1, "skipped", None), (2, "success", 302)]


def test_attempts_are_folded_without_sorting(spark):
    tries = attempts(spark, (1, 0, 0, 5, None), (2, 0, 0, 5, DENIED), (2, 0, 0, 5, DENIED))
    got = outcome.fold_attempts(tries)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert rows(got, "index_oid", "outcome", "error") == [(1, "ok", None), (2, "failed", DENIED)]


def test_the_last_row_per_key_without_sorting(spark):
    data = [("s", f"i{k % 50}", k, f"state {k % 7}", None if k % 3 else "x") for k in range(500)] + [("s", "i1", 499, "state 1", None)]
    df = spark.createDataFrame(data, "schema_name string, index_name string, seq bigint, state string, session_id string")
    got = last_per_key(df, ["schema_name", "index_name"], ["state", "session_id"], F.col("seq"))
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    want = {}
    for s, i, seq, state, session in sorted(data[:500], key=lambda r: r[2]):
        want[i] = (state, session)
    assert got.count() == 50
    assert {r.index_name: (r.state, r.session_id) for r in got.collect() if r.index_name != "i1"} == {k: v for k, v in want.items() if k != "i1"}
