import datetime as dt
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from indexward.operators import ranking, schedule
from indexward.plans.ranked_plan import write_ranked_plan

NOW = dt.datetime(2002, 1, 1, tzinfo=dt.timezone.utc)
LAYOUT = (
    "schema_name string, table_name string, index_name string, index_type string, size_bytes bigint, size_pretty string,"
    " scan_count bigint, last_scan string, estimated_bloat_percent double, last_scan_epoch bigint, schema_ord int"
)


def plan(spark, data, shuffle=None):
    """data: (index, size, scans, bloat, epoch)"""
    made = [("s", "t", n, "btree", size, "", scans, None, bloat, epoch, 0) for n, size, scans, bloat, epoch in data]
    if shuffle is not None:
        random.Random(shuffle).shuffle(made)
    return spark.createDataFrame(made, LAYOUT).repartition(3)


def ranked(df, *args, **kwargs):
    return [(r.index_name, r.score) for r in ranking.rank_plan(df, *args, **kwargs).orderBy("rank").collect()]


def test_numbers_are_dense_and_ordered(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 13).alias("k"))
    got, total = ranking.number_rows(df, [F.desc("k"), F.asc("id")])
    want = sorted(((i * 7919 % 13, i) for i in range(5000)), key=lambda p: (-p[0], p[1]))
    assert total == 5000
    assert [(r.k, r.id) for r in got.orderBy("position").collect()] == want
    assert sorted(r.position for r in got.collect()) == list(range(1, 5001))


def test_numbers_of_nothing(spark):
    got, total = ranking.number_rows(spark.range(0).toDF("id"), ["id"])
    assert total == 0 and got.count() == 0


def test_one_tie_value_is_split_over_partitions(spark):
    df = spark.range(4000).select(F.lit(0.0).alias("score"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    got, _ = ranking.number_rows(df, [F.desc("score"), F.asc("id")])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.filter(F.col("position") != F.col("id") + 1).count() == 0
    assert len(got.inputFiles()) == 4


@pytest.mark.parametrize("hot_rows", [1, 40, 10_000])
def test_rank_within_groups_of_any_size(spark, hot_rows):
    sizes = {"a": 500, "b": 1, "c": 41, "d": 40}
    data = [(g, i * 31 % n, i) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(data, "g string, v int, i int")
    got = ranking.rank_within(df, ["g"], [F.desc("v"), F.asc("i")], "r", hot_rows)
    want = {}
    for g in sizes:
        for r, (_, v, i) in enumerate(sorted((x for x in data if x[0] == g), key=lambda x: (-x[1], x[2])), 1):
            want[(g, i)] = r
    assert {(r.g, r.i): r.r for r in got.collect()} == want


def test_never_scanned_flattens_ages_as_coded(spark):
    data = [("old", 1, 0, 0.0, 0), ("new", 1, 0, 0.0, 1_000_000_000), ("never", 1, 0, 0.0, None)]
    got = ranked(plan(spark, data), "age,size", NOW)
    assert [n for n, _ in got] == ["never", "old", "new"]
    assert got[0][1] == 1.0 and 0 < got[1][1] < 1e-290 and got[2][1] == 0.0
    got = dict(ranked(plan(spark, data), "age,size", NOW, never_scanned="documented"))
    assert got == {"never": 1.0, "old": 1.0, "new": 0.0}


def test_all_never_scanned(spark):
    data = [("a", 1, 0, 0.0, None), ("b", 3, 0, 0.0, None)]
    assert ranked(plan(spark, data), "age,size", NOW) == [("b", 1.0), ("a", 0.0)]
    assert ranked(plan(spark, data), "age,size", NOW, never_scanned="documented") == [("b", 2.0), ("a", 1.0)]


def test_single_criteria_and_ties(spark):
    data = [("c", 5, 9, 1.0, 10), ("a", 5, 1, 1.0, 10), ("b", 7, 0, 0.5, None)]
    assert [n for n, _ in ranked(plan(spark, data), "size", NOW)] == ["b", "a", "c"]
    assert [n for n, _ in ranked(plan(spark, data), "scan-frequency", NOW)] == ["b", "a", "c"]
    assert [n for n, _ in ranked(plan(spark, data), "bloat", NOW)] == ["a", "c", "b"]
    assert ranked(plan(spark, data), "age", NOW)[0] == ("b", ranking.NEVER_SCANNED_AGE)


def test_repeated_criteria_count_again_and_equal_values_score_zero(spark):
    data = [("a", 10, 0, 0.0, 0), ("b", 0, 0, 1.0, 0)]
    assert ranked(plan(spark, data), "size,bloat,size", NOW) == [("a", 2.0), ("b", 1.0)]
    same = [("a", 3, 0, 2.0, 0), ("b", 3, 0, 2.0, 0)]
    assert ranked(plan(spark, same), "size,bloat", NOW) == [("a", 0.0), ("b", 0.0)]


def test_no_criteria_and_no_rows(spark):
    assert ranking.rank_plan(plan(spark, [("a", 1, 0, 0.0, 0)]), "", NOW).first()["rank"] == 0
    assert ranked(plan(spark, []), "size,age", NOW) == []
    with pytest.raises(ValueError):
        ranking.rank_plan(plan(spark, []), "size", NOW, never_scanned="maybe").count()


@settings(max_examples=5, deadline=None)
@given(
    st.lists(
        st.tuples(st.integers(0, 50), st.integers(0, 5), st.integers(0, 8), st.one_of(st.none(), st.integers(0, 99))),
        min_size=2, max_size=30,
    ),
    st.integers(0, 99),
)
def test_rank_matches_a_plain_sort_and_ignores_input_order(spark, data, seed):
    made = [(f"i{k:02d}", size, scans, bloat / 8, epoch) for k, (size, scans, bloat, epoch) in enumerate(data)]
    now = 1_009_843_200

    def metrics(row):
        age = 1.7976931348623157e308 if row[4] is None else float(now - row[4])
        return [row[3], float(row[1]), 0.0 - row[2], age]

    columns = list(zip(*[metrics(r) for r in made]))
    scaled = [[0.0 if max(c) == min(c) else (v - min(c)) / (max(c) - min(c)) for v in c] for c in columns]
    scores = [((a + b) + c) + d for a, b, c, d in zip(*scaled)]
    want = [n for _, n in sorted((-s, r[0]) for s, r in zip(scores, made))]
    got = ranked(plan(spark, made, seed), "bloat,size,scan-frequency,age", now)
    assert [n for n, _ in got] == want


def test_waves_never_share_a_table(spark):
    data = [("s", f"t{i % 7}", f"i{i:03d}", (i * 37) % 11) for i in range(200)] + [("s2", "t1", "i000", None)]
    df = spark.createDataFrame(data, "schema_name string, table_name string, index_name string, size_bytes bigint")
    for hot in (5, 1000):
        got = schedule.conflict_free_waves(df, 4, hot_rows=hot).collect()
        assert len({(r.schema_name, r.table_name, r.wave) for r in got}) == len(got) == 201
        assert len({(r.schema_name, r.table_name, r.lane) for r in got}) == 8
        assert {r.lane for r in got} <= set(range(4))
    assert {r.lane for r in schedule.conflict_free_waves(df, 4, one_table=True).collect()} == {0}
    with pytest.raises(ValueError):
        schedule.conflict_free_waves(df, 33)


def test_command_list(spark):
    df = spark.createDataFrame([("b", "y", 2), ("a", "x", 1), ("b", "a", 2)], "schema_name string, index_name string, schema_ord int")
    got = schedule.worklist_commands(df).orderBy("position").collect()
    assert [r.command for r in got] == [
        '[1/3] REINDEX INDEX CONCURRENTLY "a"."x"', '[2/3] REINDEX INDEX CONCURRENTLY "b"."a"', '[3/3] REINDEX INDEX CONCURRENTLY "b"."y"',
    ]
    assert schedule.worklist_commands(df, concurrently=False).filter("command LIKE '%CONCURRENTLY%'").count() == 0


def test_split_excluded(spark):
    df = spark.createDataFrame(
        [("s", "t", "keep", "gin", 5), ("s", "t", "drop", "gin", 5), ("s2", "t", "drop", "hash", 6), ("s", "t", "x_ccnew2", "btree", 1), ("s", "t", "Drop", "btree", 1)],
        "schema_name string, table_name string, index_name string, index_type string, size_bytes bigint",
    )
    for names in (["drop"], spark.createDataFrame([("drop",), ("drop",)], "index_name string")):
        split = schedule.split_excluded(df, names, "all", NOW)
        assert sorted(tuple(r) for r in split.logbook.select("schema_name", "index_name", "index_type", "reindex_status", "before_size").collect()) == [
            ("s", "drop", "all", "excluded", None), ("s2", "drop", "all", "excluded", None),
        ]
        assert {r.state for r in split.state_updates.collect()} == {"skipped"}
        assert sorted(r.index_name for r in split.worklist.collect()) == ["Drop", "keep"]
    assert schedule.split_excluded(df, [], "all", NOW).logbook.count() == 0


def test_the_result_plan_has_no_single_task_over_the_data(spark, cat):
    got = ranking.rank_plan(ranking.plan_inventory(cat), "bloat,size", NOW)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text and "Python" not in text and "ArrowEval" not in text


def test_plan_files(spark, cat, tmp_path):
    write_ranked_plan(cat, f"{tmp_path}/j", ["shop"], "size,age", NOW, "json")
    write_ranked_plan(cat, f"{tmp_path}/c", ["shop"], "size,age", NOW, "csv")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/j").collect()]
    assert len(lines) == 6 and sum('"last_scan":null' in line for line in lines) == 5
    assert all("epoch" not in line and "score" not in line for line in lines)
    text = sorted(r.value for r in spark.read.text(f"{tmp_path}/c").collect())
    header = "rank,schema_name,table_name,index_name,index_type,size_bytes,size_pretty,scan_count,last_scan,estimated_bloat_percent"
    assert header in text and "1,shop,orders,orders_a_ccnew,btree,5368709119,5120 MB,0,,0.00" in text


@pytest.mark.parametrize("broadcast", [True, False])
def test_groups_of_any_size_are_numbered_by_prefix_sums(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(ranking, "MAX_BROADCAST_RUNS", 0)
    group = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 97))
    df = spark.range(6000).select(group.alias("g"), ((F.col("id") * 7919) % 6007).alias("v"))
    expected = {}
    for g, v in sorted(((r.g, r.v) for r in df.collect()), key=lambda r: (r[0] or "", r[1])):
        expected.setdefault(g, []).append(v)
    got = ranking.number_in_groups(df, ["g"], ["v"], "at", "n")
    plan = got._jdf.queryExecution().toString()
    rows_ = got.collect()
    assert len(rows_) == 6000
    assert all(expected[r["g"]][r["at"] - 1] == r["v"] and r["n"] == len(expected[r["g"]]) for r in rows_)
    # The only join goes by partition and group, never by the group alone.
    keys = re.findall(r"Join \[([^\]]*)\]", plan.partition("== Physical Plan ==")[2])
    assert keys and all("_part" in k for k in keys)
    assert ranking.number_in_groups(df.limit(0), ["g"], ["v"]).count() == 0
