import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from indexward import functions as fn
from indexward.operators import filters


def values(spark, data, kind, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {kind}")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def test_size_pretty_follows_the_server(spark):
    mib, gib = 1 << 20, 1 << 30
    cases = {
        0: "0 bytes", 10239: "10239 bytes", 10240: "10 kB", 10752: "11 kB", 10751: "10 kB",
        10485247: "10239 kB", 10485248: "10 MB", 10736893951: "10239 MB", 10736893952: "10 GB", 45678592: "44 MB",
        20480 * mib: "20 GB", 20480 * gib: "20 TB", 20480 * (gib << 10): "20 PB", (1 << 63) - 1: "8192 PB",
        -5: "-5 bytes", -10752: "-11 kB",
    }
    got = values(spark, list(cases), "bigint", fn.size_pretty(F.col("v")))
    assert [g[0] for g in got] == list(cases.values())
    assert values(spark, [None], "bigint", fn.size_pretty(F.col("v"))) == [(None,)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, (1 << 63) - 1), min_size=50, max_size=50))
def test_size_gb_text_is_exact(spark, sizes):
    ties = [(2 * k + 1) * (1 << 29) // 100 for k in range(20)]
    want = [str((Decimal(s) / Decimal(1 << 30)).quantize(Decimal("0.01"), ROUND_HALF_UP)) + " GB" for s in sizes + ties]
    assert [g[0] for g in values(spark, sizes + ties, "bigint", fn.size_gb_text(F.col("v")))] == want


def test_temp_rebuild_names(spark):
    cases = {
        "a_ccnew": True, "a_ccnew1": True, "a_ccnew123": True, "_ccnew": True, "a_ccnew_x": False, "a_ccnew_b_ccnew": False,
        "a_ccnew1\n": False, "a_CCNEW": False, "a": False, "a_ccnew٣": False, "_ccnew_ccnew": False,
    }
    got = values(spark, list(cases), "string", fn.is_temp_rebuild_name(F.col("v")))
    assert [g[0] for g in got] == list(cases.values())


def test_bloat_measures(spark):
    df = spark.createDataFrame(
        [(60, 500, 100, 1000, 10, 100), (5, 10, 100, 10, 50, 100), (1, 1, 0, 5, 1, 1), (1, 1, 5, 0, 7, 0), (1, None, 5, 5, 1, 3)],
        "ip bigint, it bigint, tp bigint, tt bigint, isz bigint, tsz bigint",
    )
    c = F.col
    got = df.select(
        fn.estimated_bloat(c("ip"), c("it"), c("tp"), c("tt")), fn.page_drift_bloat(c("ip"), c("tp"), c("isz"), c("tsz"))
    ).collect()
    assert [tuple(r) for r in got] == [(10.0, 50.0), (0.0, -45.0), (0.0, 0.0), (0.0, 0.0), (0.0, -13.33)]


def test_scan_times_do_not_depend_on_the_session_zone(spark):
    at = dt.datetime(2024, 7, 1, 23, 59, 59, 500000, tzinfo=dt.timezone.utc)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", name)
            c = fn.as_timestamp(at)
            got = spark.range(1).select(fn.last_scan_iso(c), fn.log_timestamp(c), fn.epoch_secs(c)).first()
            assert tuple(got) == ("2024-07-01T23:59:59Z", "2024-07-01 23:59:59.500", int(at.timestamp()) + 1)
            line = spark.createDataFrame([("[2024-07-01 23:59:59.500] [INFO] x",)], "value string")
            from indexward.sources.logs import parse_log_lines

            assert parse_log_lines(line).select(fn.log_timestamp(F.col("timestamp"))).first()[0] == "2024-07-01 23:59:59.500"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_log_positions_are_unsigned(spark):
    got = values(spark, ["FFFFFFFF/FFFFFFFF", "0/10", "16/B374D848", None], "string", fn.lsn_bytes(F.col("v")))
    assert [g[0] and int(g[0]) for g in got] == [2**64 - 1, 16, 0x16B374D848, None]
    diff = values(spark, ["FFFFFFFF/0"], "string", fn.lsn_diff(F.col("v"), F.lit("0/1")))
    assert int(diff[0][0]) == 0xFFFFFFFF * 2**32 - 1


def test_changes_and_rounding(spark):
    df = spark.createDataFrame([(200, 150), (0, 5), (3, 4), (None, 1)], "b bigint, a bigint")
    got = [r[0] for r in df.select(fn.size_change_pct(F.col("b"), F.col("a"))).collect()]
    assert got[:2] == [25.0, 0.0] and got[2] == pytest.approx(-100 / 3) and got[3] is None
    got = values(spark, [0.25, -0.25, 1.04, 12.349], "double", fn.round1(F.col("v")).cast("string"))
    assert [g[0] for g in got] == ["0.3", "-0.3", "1.0", "12.3"]


def test_error_classes(spark):
    cases = {
        "ERROR: Canceling statement due to LOCK timeout": (True, False, "lock timeout"),
        "ERROR: deadlock detected": (True, False, "deadlock"),
        "canceling statement due to lock timeout while in a deadlock": (True, False, "deadlock"),
        "canceling statement due to lock timeout, connection lost": (True, False, "lock timeout"),
        "connection closed": (True, True, "connection error"),
        "Broken pipe (os error 32)": (True, True, "connection error"),
        "server closed the connection unexpectedly": (True, True, "connection error"),
        "permission denied": (False, False, None),
    }
    got = values(spark, list(cases), "string", fn.classify_error(F.col("v")).alias("k"))
    assert [tuple(g[0]) for g in got] == list(cases.values())
    assert values(spark, [None], "string", fn.classify_error(F.col("v"))) == [(None,)]


def test_quoting_and_lists(spark):
    cases = {"plain": "plain", "a,b": '"a,b"', 'say "x"': '"say ""x"""', "two\nlines": '"two\nlines"', "": ""}
    got = values(spark, list(cases), "string", fn.csv_quote(F.col("v")))
    assert [g[0] for g in got] == list(cases.values())
    got = values(spark, [" a, ,b\t,,c d "], "string", fn.split_list(F.col("v")))
    assert got[0][0] == ["a", "b", "c d"] == fn.split_names(" a, ,b\t,,c d ")


def test_arguments():
    assert fn.parse_criteria(" Bloat,SIZE ,bloat") == ["bloat", "size", "bloat"]
    for bad in ("", "bloat,", "weight"):
        with pytest.raises(ValueError):
            fn.parse_criteria(bad)
    assert fn.parse_index_kind("") == "all" and fn.parse_index_kind("BTree") == "btree"
    assert fn.validate_threads(8, one_table=True) == 1
    assert fn.parse_size_order("DESC") == "desc" and fn.parse_size_order(None) is None
    for check in (
        lambda: fn.validate_threads(33), lambda: fn.validate_threads(0), lambda: fn.validate_bloat_threshold(101),
        lambda: fn.validate_size_band(3, 2), lambda: fn.validate_work_mem(33), lambda: fn.validate_schemas([]),
        lambda: fn.validate_schemas(["s"] * 513), lambda: fn.parse_plan_format("xml"), lambda: fn.parse_size_order("up"),
        lambda: fn.parse_index_kind("hash"),
    ):
        with pytest.raises(ValueError):
            check()


def test_user_schemas_treat_underscore_as_wildcard(spark):
    names = ["pg_catalog", "pg_temp_3", "pgxtempy", "pg-temp-x", "app", "pg_toast_temp_1x", "tool", "Pg_temp_3", "pgtemp_1"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "oid bigint, nspname string")
    got = [r[0] for r in filters.user_schemas(df, tool_schemas=["tool"]).collect()]
    assert got == ["Pg_temp_3", "app", "pgtemp_1"]


def test_schema_lists(spark):
    df = filters.schema_list(spark, "b, a,,b,c,b")
    assert [tuple(r) for r in filters.dedupe_schemas(df).orderBy("schema_ord").collect()] == [("b", 1), ("a", 2), ("c", 4)]
    assert tuple(filters.schema_duplicates(df).first()) == (2, 3)
