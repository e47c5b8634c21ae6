"""Ranks over any number of rows, and the ranked plan.

A window without partitions, or with one huge partition, sorts everything in
one task. Here rows are range-partitioned by the sort keys instead, so equal
scores and hot groups are split, and every partition gets the position of its
first row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import as_epoch, epoch_secs, estimated_bloat, last_scan_iso, parse_criteria, size_pretty
from ..keys import fleet_keys
from ..sources.scratch import materialize, scratch_table
from .inventory import Catalog, in_schemas, index_relations

# A group up to this many rows may be sorted in one task.
HOT_GROUP_ROWS = 1_000_000

# Age of an index that was never scanned: the largest finite double.
NEVER_SCANNED_AGE = 1.7976931348623157e308

# Runs (or hot groups) up to this many are broadcast: a few MB of keys and counts.
MAX_BROADCAST_RUNS = 50_000

_ROW_BITS = 33


def number_rows(
    df: DataFrame, order: Sequence[Column | str], column: str = "position", in_order: bool = False,
) -> tuple[DataFrame, int]:
    """Number all rows 1..n in the given order; returns the numbered rows and n.

    The sorted partitions are written once, because range bounds come from a
    sample and a second evaluation could move rows. Counting then reads a single
    column, and the offsets to broadcast are one per partition. ``in_order``:
    the files are read one by one, so that the rows of the result also come in
    that order and need no further sort.
    """
    spark = df.sparkSession
    row_id = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row_id", row_id)
    stored = materialize(ranged, "numbered")
    part = F.shiftright("_row_id", _ROW_BITS).cast("int")
    local = F.col("_row_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    file = F.col("_metadata.file_path")
    counts = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"), F.max(file).alias("file")).orderBy("_part").collect()
    starts = [0, *accumulate(r["n"] for r in counts)]
    if in_order and counts:
        read = spark.read.schema(stored.schema)
        files = [read.parquet(r["file"]).withColumn(column, F.lit(start) + local + 1) for r, start in zip(counts, starts)]
        return _one_after_another(files).select(*df.columns, column), starts[-1]
    offsets = spark.createDataFrame(
        [(r["_part"], start) for r, start in zip(counts, starts)], "_part int, _start bigint"
    )
    numbered = stored.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    numbered = numbered.withColumn(column, F.col("_start") + local + 1)
    return numbered.select(*df.columns, column), starts[-1]


def _one_after_another(frames: Sequence[DataFrame]) -> DataFrame:
    """The rows of the frames in their order: a union in halves, which is analysed once per level."""
    if len(frames) == 1:
        return frames[0]
    half = len(frames) // 2
    return _one_after_another(frames[:half]).unionAll(_one_after_another(frames[half:]))


def number_in_groups(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], column: str = "position", total: str | None = None,
) -> DataFrame:
    """Number the rows of each group 1..n in the given (total) order, and add the group's size as ``total``; no group is too large.

    Rows are range-partitioned by group and order and written once. Inside a
    partition the rows of a group stand together, so a row's number is its place
    in that run plus the rows of the group in earlier partitions. These are
    prefix sums over one row per partition and group. A run is never larger than
    a partition, so the join back is by run and not by group: of a broadcast
    table while there are at most ``MAX_BROADCAST_RUNS``, else by shuffle.
    """
    keys = [F.col(g) for g in group]
    row_id = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_row_id", row_id)
    stored = materialize(ranged, "numbered").withColumn("_part", F.shiftright("_row_id", _ROW_BITS).cast("int"))
    counted = stored.groupBy("_part", *group).agg(F.min("_row_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*group).orderBy("_part")
    before = F.sum("_rows").over(earlier) - F.col("_rows")
    size = F.sum("_rows").over(Window.partitionBy(*group))
    runs = counted.select(
        F.col("_part").alias("_run"), *[F.col(g).alias(f"_of_{i}") for i, g in enumerate(group)],
        (before - F.col("_first") + 1).alias("_shift"), size.alias("_size"),
    )
    runs = materialize(runs, "runs")
    same = F.col("_part") == F.col("_run")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_of_{i}"))
    if runs.count() <= MAX_BROADCAST_RUNS:
        runs = F.broadcast(runs)
    totals = [F.col("_size").alias(total)] if total else []
    return stored.join(runs, same).select(*df.columns, (F.col("_row_id") + F.col("_shift")).alias(column), *totals)


def rank_within(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], column: str, hot_rows: int = HOT_GROUP_ROWS,
    stored: bool = False,
) -> DataFrame:
    """Number the rows of each group 1..n in the given (total) order.

    Groups are counted first, with map-side combining. Groups of ordinary size
    go through a window; those above ``hot_rows`` through ``number_in_groups``.
    The rows are written first, so that counting costs a scan of the group
    columns; say ``stored`` when they already come from a table.
    """
    if not group:
        return number_rows(df, order, column)[0]
    if not stored:
        df = materialize(df, "ranked")
    hot = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).select(*group)
    window = Window.partitionBy(*group).orderBy(*order)
    if hot.isEmpty():
        return df.withColumn(column, F.row_number().over(window).cast("bigint"))
    hot = materialize(hot, "hot-groups")
    if hot.count() <= MAX_BROADCAST_RUNS:
        hot = F.broadcast(hot)
    usual = df.join(hot, list(group), "left_anti").withColumn(column, F.row_number().over(window).cast("bigint"))
    split = number_in_groups(df.join(hot, list(group), "left_semi").select(*df.columns), group, order, column)
    return usual.unionByName(split).select(*df.columns, column)


def plan_facts(
    cat: Catalog, schemas: str | Sequence[str] | None = None, tool_schemas: Sequence[str] = ()
) -> DataFrame:
    """All indexes of the schemas with scan statistics and estimated bloat, without what ``with_plan_texts`` derives from that.

    No kind or size filter: constraints are included. A schema that is listed
    twice gives its rows twice.
    """
    rows = in_schemas(index_relations(cat, with_stats=True), schemas, tool_schemas, repeats=True)
    bloat = estimated_bloat(F.col("index_pages"), F.col("index_tuples"), F.col("table_pages"), F.col("table_tuples"))
    return rows.select(
        *fleet_keys(rows), "schema_name", "table_name", "index_name", "index_type", "size_bytes",
        F.coalesce("idx_scan", F.lit(0)).alias("scan_count"), "last_idx_scan", bloat.alias("estimated_bloat_percent"), "schema_ord",
    )


def with_plan_texts(facts: DataFrame) -> DataFrame:
    """Size and last scan as text, and the last scan in epoch seconds, in place of its time."""
    made = {
        "size_bytes": [F.col("size_bytes"), size_pretty(F.col("size_bytes")).alias("size_pretty")],
        "last_idx_scan": [last_scan_iso(F.col("last_idx_scan")).alias("last_scan")],
        "estimated_bloat_percent": [F.col("estimated_bloat_percent"), epoch_secs(F.col("last_idx_scan")).alias("last_scan_epoch")],
    }
    return facts.select(*[c for name in facts.columns for c in made.get(name, [F.col(name)])])


def plan_inventory(
    cat: Catalog, schemas: str | Sequence[str] | None = None, tool_schemas: Sequence[str] = ()
) -> DataFrame:
    """All indexes of the schemas with scan statistics and estimated bloat, as ``plan_facts``, and their texts."""
    return with_plan_texts(plan_facts(cat, schemas, tool_schemas))


def _scan_epoch(facts: bool) -> Column:
    return epoch_secs(F.col("last_idx_scan")) if facts else F.col("last_scan_epoch")


def plan_metric(criterion: str, now, facts: bool = False) -> Column:
    """What one criterion measures, over an inventory or its ``facts``; larger is more urgent."""
    return {
        "bloat": lambda: F.col("estimated_bloat_percent"),
        "size": lambda: F.col("size_bytes").cast("double"),
        "scan-frequency": lambda: F.lit(0.0) - F.col("scan_count").cast("double"),
        "age": lambda: F.when(_scan_epoch(facts).isNull(), F.lit(NEVER_SCANNED_AGE)).otherwise(
            (as_epoch(now) - _scan_epoch(facts)).cast("double")
        ),
    }[criterion]()


def _bound_columns(criteria: Sequence[str], now, scanned_only: bool, facts: bool = False) -> list[Column]:
    bounds = []
    for criterion in dict.fromkeys(criteria):
        metric = plan_metric(criterion, now, facts)
        if scanned_only and criterion == "age":
            metric = F.when(_scan_epoch(facts).isNotNull(), metric)
        bounds += [F.min(metric).alias(f"lo_{criterion}"), F.max(metric).alias(f"hi_{criterion}")]
    return bounds


def criterion_bounds(plan: DataFrame, criteria: Sequence[str], now, scanned_only: bool = False) -> DataFrame:
    """Smallest and largest metric per criterion (per snapshot, when there are several).

    ``scanned_only`` leaves indexes without a scan out of the bounds of age.
    """
    return plan.groupBy(*fleet_keys(plan)).agg(*_bound_columns(criteria, now, scanned_only))


def plan_score(criteria: Sequence[str], now, never_scanned: str, bound: Callable[[str], Column], facts: bool = False) -> Column:
    """The metric of a single criterion, else the sum of the scaled metrics; ``bound`` gives their ``lo_`` and ``hi_``."""
    if never_scanned not in ("code", "documented"):
        raise ValueError(f"never_scanned must be 'code' or 'documented', got '{never_scanned}'")
    if len(criteria) == 1:
        return plan_metric(criteria[0], now, facts)
    total = F.lit(0.0)
    for criterion in criteria:
        low, high = bound(f"lo_{criterion}"), bound(f"hi_{criterion}")
        scaled = F.when(high == low, F.lit(0.0)).otherwise((plan_metric(criterion, now, facts) - low) / (high - low))
        if never_scanned == "documented" and criterion == "age":
            scaled = F.when(_scan_epoch(facts).isNull(), F.lit(1.0)).otherwise(scaled)
        total = total + scaled
    return total


def plan_scores(
    plan: DataFrame, criteria: Sequence[str], now, never_scanned: str = "code", bounds: Mapping[str, float | None] | None = None
) -> DataFrame:
    """Add ``score``: the metric of a single criterion, else the sum of the scaled metrics.

    Each metric is scaled to 0..1 over its own range (0 when all are equal) and
    added in the given order. ``never_scanned="code"`` keeps the largest double
    as an ordinary age, which flattens all other ages to about 0;
    ``"documented"`` scales the scanned indexes among themselves and gives 1 to
    the others. ``bounds`` are those of ``criterion_bounds`` where they are
    already known (for a plan without leading keys).
    """
    if len(criteria) == 1:
        return plan.withColumn("score", plan_score(criteria, now, never_scanned, F.col))
    lead, extra = fleet_keys(plan), []
    if bounds is not None:
        rows, bound = plan, _known(bounds)
    else:
        table = criterion_bounds(plan, criteria, now, never_scanned == "documented")
        extra = [c for c in table.columns if c not in lead]
        rows, bound = (plan.join(table, lead), F.col) if lead else (plan, lambda name: table.select(name).scalar())
    return rows.withColumn("score", plan_score(criteria, now, never_scanned, bound)).drop(*extra)


def _known(bounds: Mapping[str, float | None]) -> Callable[[str], Column]:
    return lambda name: F.lit(bounds.get(name)).cast("double")


def rank_plan(plan: DataFrame, sort_by: str | Sequence[str], now, never_scanned: str = "code", in_order: bool = False) -> DataFrame:
    """Rank by descending score, per snapshot when there are several.

    Equal scores keep list order: schema position, schema, then index name. With
    several criteria the inventory is written first, and the bounds of the
    criteria are observed while it is written. Of ``plan_facts``, only these are
    shuffled and written, and the texts are made of the ranked rows.
    ``in_order``: the partitions of a global rank, and the rows inside each, come in its order.
    """
    criteria = parse_criteria(sort_by) if sort_by else []
    facts = "last_idx_scan" in plan.columns
    finish = with_plan_texts if facts else lambda rows: rows
    dropped = ("last_scan_epoch", "schema_ord")
    if not criteria:
        return finish(plan).withColumn("rank", F.lit(0).cast("bigint"))
    lead = fleet_keys(plan)
    ties = [F.asc("schema_ord"), F.asc("schema_name"), F.asc("index_name")]
    if lead:
        rows = materialize(plan, "plan") if len(criteria) > 1 else plan
        full = rows.withColumn("last_scan_epoch", _scan_epoch(facts)) if facts else rows
        scored = plan_scores(full, criteria, now, never_scanned)
        scored = scored.drop("last_scan_epoch") if facts else scored
        return finish(rank_within(scored, lead, [F.desc("score"), *ties], "rank", stored=len(criteria) > 1)).drop(*dropped)

    def ranked(rows: DataFrame, bounds: Mapping[str, float | None]) -> DataFrame:
        scored = rows.withColumn("score", plan_score(criteria, now, never_scanned, _known(bounds), facts))
        return finish(number_rows(scored, [F.desc("score"), *ties], "rank", in_order)[0]).drop(*dropped)

    if len(criteria) == 1:
        return ranked(plan, {})
    seen = Observation("bounds")
    observed = plan.observe(seen, *_bound_columns(criteria, now, never_scanned == "documented", facts))
    # A global rank writes a table of its own, so this one is not needed afterwards.
    with scratch_table(observed, "plan") as inventory:
        return ranked(inventory, seen.get)
