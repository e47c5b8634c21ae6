import datetime as dt
import json

from pyspark.sql import functions as F

from indexward import schemas as S
from indexward.operators import outcome
from indexward.sources import read_log_json, read_log_text, to_log_json, to_log_text, write_plan_csv, write_plan_json

from conftest import rows

AT = dt.datetime(2002, 1, 2, 3, 4, 5, 678901)


def events(spark):
    return spark.createDataFrame(
        [(AT, "INFO", 'hello "x"', None, None, 3), (AT, "ERROR", "bad [y] z", "failed", 1.5, None)],
        "timestamp timestamp, level string, message string, status string, duration_secs double, total_indexes long",
    )


def test_json_leaves_absent_fields_out(spark, tmp_path):
    lines = [json.loads(r.value) for r in to_log_json(events(spark)).collect()]
    assert lines == [
        {"timestamp": "2002-01-02 03:04:05.678", "level": "INFO", "message": 'hello "x"', "total_indexes": 3},
        {"timestamp": "2002-01-02 03:04:05.678", "level": "ERROR", "message": "bad [y] z", "status": "failed", "duration_secs": 1.5},
    ]
    to_log_json(events(spark)).coalesce(1).write.mode("append").text(f"{tmp_path}/log")
    spark.createDataFrame([("not json",)], "value string").write.mode("append").text(f"{tmp_path}/log")
    got = read_log_json(spark, f"{tmp_path}/log")
    assert rows(got, "level", "timestamp", "status", "corrupt_record") == sorted([
        ("ERROR", AT.replace(microsecond=678000), "failed", None), ("INFO", AT.replace(microsecond=678000), None, None),
        (None, None, None, "not json"),
    ], key=repr)
    assert set(S.LOG_EVENT_SCHEMA.names) <= set(got.columns)


def test_text_lines(spark, tmp_path):
    assert [r.value for r in to_log_text(events(spark)).collect()] == [
        '[2002-01-02 03:04:05.678] [INFO] hello "x"', "[2002-01-02 03:04:05.678] [ERROR] bad [y] z",
    ]
    to_log_text(events(spark)).write.text(f"{tmp_path}/log")
    spark.createDataFrame([("  continued",), ("[2002-99-02 03:04:05.678] [INFO] x",)], "value string").write.mode("append").text(f"{tmp_path}/log")
    got = read_log_text(spark, f"{tmp_path}/log")
    assert rows(got, "timestamp", "level", "message") == sorted([
        (AT.replace(microsecond=678000), "INFO", 'hello "x"'), (AT.replace(microsecond=678000), "ERROR", "bad [y] z"),
        (None, None, None), (None, "INFO", "x"),
    ], key=repr)


def test_reports(spark):
    assert rows(outcome.log_report(events(spark)), "level", "status", "n_events") == [("ERROR", "failed", 1), ("INFO", None, 1)]


def test_csv_bytes(spark, tmp_path):
    layout = (
        "rank long, schema_name string, table_name string, index_name string, index_type string, size_bytes long,"
        " size_pretty string, scan_count long, last_scan string, estimated_bloat_percent double"
    )
    data = [
        (2, "s", " t ", 'say "hi"', "btree", 1, "1 bytes", 0, None, 1.234),
        (1, "s", "a,b", "", "btree", 1, "1 bytes", 0, "2002-01-01T00:00:00Z", 10.0),
    ]
    df = spark.createDataFrame(data, layout)
    write_plan_csv(df.coalesce(1), f"{tmp_path}/c")
    text = "".join(f.read_text() for f in sorted((tmp_path / "c").glob("part-*")))
    assert text.splitlines()[1:] == [
        '1,s,"a,b",,btree,1,1 bytes,0,2002-01-01T00:00:00Z,10.00', '2,s, t ,"say ""hi""",btree,1,1 bytes,0,,1.23',
    ]
    write_plan_json(df, f"{tmp_path}/j")
    lines = [json.loads(line) for f in sorted((tmp_path / "j").glob("part-*")) for line in f.read_text().splitlines()]
    assert [line["rank"] for line in lines] == [1, 2] and lines[1]["last_scan"] is None


def test_messages_with_line_breaks(spark, tmp_path):
    messages = ["one", "two\nlines", "blank\n\n  end", "DETAIL: a\n[not a record] b", "ends\n", "last"]
    df = spark.createDataFrame([(AT, "ERROR", m) for m in messages], "timestamp timestamp, level string, message string")
    (tmp_path / "log").write_text("before any record\n" + "\n".join(r.value for r in to_log_text(df).collect()) + "\n")
    # Records must also survive the borders of splits.
    spark.conf.set("spark.sql.files.maxPartitionBytes", 16)
    got = read_log_text(spark, f"{tmp_path}/log").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.message for r in got if r.level) == sorted(["one", "two\nlines", "blank\n\n  end", "DETAIL: a", "ends", "last"])
    assert sorted(r.raw for r in got if not r.level) == ["before any record", "not a record] b"]


def test_reports_of_a_fleet(spark):
    fleet = events(spark).withColumn("instance_id", F.explode(F.array(F.lit(1), F.lit(2))))
    assert rows(outcome.log_report(fleet), "instance_id", "level", "n_events") == [(1, "ERROR", 1), (1, "INFO", 1), (2, "ERROR", 1), (2, "INFO", 1)]


def test_events_at_the_start(spark):
    listed = spark.createDataFrame([(1, 2, "s", "i", "btree"), (2, 2, "s", "j", "gin")], "position bigint, total bigint, schema_name string, index_name string, index_type string")
    got = outcome.start_events(listed, AT)
    assert rows(got, "message", "status", "current_index", "total_indexes") == [
        ("[1/2] Starting reindex: s.i (btree)", "starting", 1, 2), ("[2/2] Starting reindex: s.j (gin)", "starting", 2, 2),
    ]
    setup = outcome.setup_events(spark, AT, 2, 4, 64, 10, 0, 1024)
    assert rows(setup, "message", "lock_timeout_seconds", "max_size_gb") == [
        ("Index size limits: minimum 0 GB, maximum 1024 GB", None, 1024),
        ("Session parameters: maintenance_work_mem=2GB, max_parallel_maintenance_workers=4, maintenance_io_concurrency=64, lock_timeout=10s", 10, None),
    ]
    assert set(setup.columns) <= set(S.LOG_EVENT_SCHEMA.names) and set(got.columns) <= set(S.LOG_EVENT_SCHEMA.names)
    assert len([json.loads(r.value) for r in to_log_json(setup).collect()]) == 2
