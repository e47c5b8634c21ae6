import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def cat(spark):
    """A small catalog: two user schemas, a system schema, plain and partitioned tables."""
    from indexward import schemas as S

    gib = 1 << 30
    classes = [
        # tables: oid, name, namespace, kind, am, pages, tuples, size
        (10, "users", 1, "r", 0, 100, 1000, 8 * gib),
        (11, "orders", 1, "r", 0, 0, 0, 0),
        (12, "users", 2, "r", 0, 50, 100, gib),
        (13, "log", 1, "p", 0, 0, 0, 0),
        (14, "empty_log", 1, "p", 0, 0, 0, 0),
        (15, "log_1", 2, "r", 0, 10, 10, gib),
        (16, "log_2", 1, "r", 0, 10, 10, gib),
        (17, "sys", 3, "r", 0, 1, 1, 1),
        # indexes
        (20, "users_pk", 1, "i", 1, 50, 1000, gib),
        (21, "users_name", 1, "i", 1, 60, 500, gib),
        (22, "users_gin", 1, "i", 3, 10, 1000, 2 * gib),
        (23, "orders_a_ccnew", 1, "i", 1, 10, 10, 5 * gib - 1),
        (24, "users_name", 2, "i", 1, 5, 100, 5 * gib),
        (25, "log_1_idx", 2, "i", 2, 5, 10, gib),
        (26, "log_2_idx", 1, "i", 1, 5, 10, gib),
        (27, "log_parent_idx", 1, "I", 1, 0, 0, 0),
        (28, "sys_idx", 3, "i", 1, 1, 1, 1),
        (29, "users_uq", 1, "i", 1, 20, 1000, gib),
    ]
    ok = (True, True, True)
    indexes = [
        (20, 10, True, True, *ok), (21, 10, False, False, *ok), (22, 10, False, False, True, False, True),
        (23, 11, False, False, False, True, True), (24, 12, False, False, *ok), (25, 15, False, False, *ok),
        (26, 16, False, False, *ok), (27, 13, False, False, *ok), (28, 17, False, False, *ok), (29, 10, False, True, *ok),
    ]
    import datetime as dt

    at = dt.datetime(2001, 1, 1, 12, 0, 0, 600000)
    make = spark.createDataFrame
    return {
        "namespace": make([(1, "shop"), (2, "audit"), (3, "pg_catalog"), (4, "pg_temp_9"), (5, "tool")], S.NAMESPACE),
        "am": make([(1, "btree"), (2, "hash"), (3, "gin")], S.AM),
        "class": make(classes, S.CLASS),
        "index": make(indexes, S.INDEX),
        "stat_index": make([(20, 5, at), (21, 0, None), (24, 7, at)], S.STAT_INDEX),
        "inherits": make([(15, 13), (16, 13)], S.INHERITS),
    }


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
