"""Index inventories from catalog snapshots.

Catalog frames come as a dict with the keys ``namespace, am, class, index,
stat_index, inherits``. No join carries a broadcast hint: namespaces and access
methods of one database are small and Spark broadcasts them by their measured
size; those of a whole fleet may not be, and are then shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_temp_rebuild_name, page_drift_bloat, parse_size_order, size_gb_text, split_names
from ..keys import fleet_keys, index_keys
from ..schemas import MAX_SCHEMAS
from ..sources.scratch import materialize
from .filters import filter_index_kind, filter_relkind, filter_size_gb, filter_table, is_user_schema, schema_list

Catalog = Mapping[str, DataFrame]

# Index names up to this many are broadcast to reduce the class scan: some 50 MB.
MAX_BROADCAST_NAMES = 500_000

# Ids of an access method up to this many become a condition on the classes.
MAX_METHOD_IDS = 1_000

INVENTORY_COLUMNS = ("schema_name", "table_name", "index_name", "index_size", "index_type", "size_bytes")


def _renamed(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*fleet_keys(df), *[F.col(old).alias(new) for new, old in names.items()])


def _join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    return left.join(right, [*fleet_keys(left, right), on], how)


def _not_indexes(classes: DataFrame) -> DataFrame:
    """What can have indexes or be a partition of a table: any relation that is not an index itself, which most are."""
    return classes.filter(~F.col("relkind").eqNullSafe("i"))


def within_ids(rows: DataFrame, column: str, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows whose id lies between the smallest and the largest of ``ids``, dropped where they are scanned.

    For a join that needs no others: it is the same with fewer rows to shuffle. Ids of a kind are often neighbours.
    """
    low, high = ids.agg(F.min(id_column), F.max(id_column)).first()
    return rows.filter(F.col(column).between(F.lit(low), F.lit(high)))


def index_relations(
    cat: Catalog, with_stats: bool = False, with_method: bool = True, relkind: str | None = "i", named: DataFrame | None = None,
    stored: bool = False,
) -> DataFrame:
    """One wide row per index: names, sizes, flags, and page and tuple counts of index and table.

    Unused columns are pruned and later filters sink below the joins: a schema
    filter reaches the namespaces and shrinks the table side before it is
    shuffled. The joins on the index id come first and share one partitioning.
    ``named`` keeps the indexes whose name is in its ``index_name``, where the
    classes are scanned; say ``stored`` when they come from a table.
    """
    index_class = cat["class"] if relkind is None else filter_relkind(cat["class"], relkind)
    if named is not None:
        index_class = _of_names(index_class, named, stored)
    rows = _join(
        _renamed(
            cat["index"], index_oid="indexrelid", table_oid="indrelid", is_primary="indisprimary", is_unique="indisunique",
            is_valid="indisvalid", is_ready="indisready", is_live="indislive",
        ),
        _renamed(
            index_class, index_oid="oid", index_name="relname", am_oid="relam", size_bytes="relsize",
            index_pages="relpages", index_tuples="reltuples",
        ),
        "index_oid",
    )
    if with_stats:
        stats = _renamed(cat["stat_index"], index_oid="indexrelid", idx_scan="idx_scan", last_idx_scan="last_idx_scan")
        rows = _join(rows, stats, "index_oid", "left")
    tables = _join(
        _renamed(
            _not_indexes(cat["class"]), table_oid="oid", table_name="relname", namespace_oid="relnamespace", table_pages="relpages",
            table_tuples="reltuples", table_size="relsize",
        ),
        _renamed(cat["namespace"], namespace_oid="oid", schema_name="nspname"),
        "namespace_oid",
    )
    rows = _join(rows, tables, "table_oid")
    return _join(rows, _renamed(cat["am"], am_oid="oid", index_type="amname"), "am_oid") if with_method else rows


def _of_names(classes: DataFrame, named: DataFrame, stored: bool = False) -> DataFrame:
    """Classes with one of the index names, reduced before any shuffle; all classes if the names are too many to broadcast.

    Names that come from a table (``stored``) are estimated first, and not written where there are far too many.
    """
    if stored and named.agg(F.approx_count_distinct("index_name")).first()[0] > 2 * MAX_BROADCAST_NAMES:
        return classes
    names = materialize(named.select(F.col("index_name").alias("_name")).distinct(), "index-names")
    if names.count() > MAX_BROADCAST_NAMES:
        return classes
    return classes.join(F.broadcast(names), F.col("relname") == F.col("_name"), "left_semi")


def _of_method(cat: Catalog, method: str) -> Catalog:
    """The catalog without indexes of other access methods, where the ids of the method are few: dropped before any shuffle.

    The join to the methods still decides; ids of all databases of a fleet are taken together here.
    """
    ids = [r[0] for r in cat["am"].filter(F.col("amname") == method).select("oid").distinct().limit(MAX_METHOD_IDS + 1).collect()]
    if len(ids) > MAX_METHOD_IDS:
        return cat
    return {**cat, "class": cat["class"].filter(~F.col("relkind").eqNullSafe("i") | F.col("relam").isin(ids))}


def _of_ids(rows: DataFrame, column: str, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows with one of the ids."""
    on = fleet_keys(rows, ids)
    return rows.join(ids.select(*on, F.col(id_column).alias(column)).distinct(), [*on, column], "left_semi").select(*rows.columns)


def named_catalog(cat: Catalog, names: Sequence[str]) -> Catalog:
    """The part of a catalog that is needed to find the indexes of some names, such as those that a run excludes.

    What has these names is written, and so are its rows of ``index``. They are few, so the other relations are reduced by their
    ids before they are joined.
    """
    indexes = filter_relkind(cat["class"], "i").filter(F.col("relname").isin(list(names)))
    indexes = materialize(indexes, "named-classes")
    index = materialize(_of_ids(cat["index"], "indexrelid", indexes, "oid"), "named-index")
    tables = _of_ids(_not_indexes(cat["class"]), "oid", index, "indrelid")
    return {**cat, "class": indexes.unionByName(tables), "index": index}


def in_schemas(
    df: DataFrame, schemas: str | Sequence[str] | None, tool_schemas: Sequence[str] = (), repeats: bool = False
) -> DataFrame:
    """Keep the listed schemas (all user schemas for None) and add their list position ``schema_ord``.

    Without ``repeats`` a schema named twice counts once; with it, its rows
    repeat. A list of at most 512 names is broadcast, a longer one (only plans
    take it) as Spark decides by size; the plain predicate beside it is what
    sinks to the namespace scan.
    """
    if schemas is None:
        return df.filter(is_user_schema(F.col("schema_name"), tool_schemas)).withColumn("schema_ord", F.lit(0))
    names = split_names(schemas) if isinstance(schemas, str) else list(schemas)
    if not repeats:
        names = list(dict.fromkeys(names))
    wanted = schema_list(df.sparkSession, names, limited=not repeats)
    if len(names) <= MAX_SCHEMAS:
        wanted = F.broadcast(wanted)
    return df.filter(F.col("schema_name").isin(sorted(set(names)))).join(wanted, "schema_name")


def index_inventory(
    cat: Catalog, schemas: str | Sequence[str] | None = None, table: str | None = None, min_gb: int = 0,
    max_gb: int | None = None, kind: str = "btree", tool_schemas: Sequence[str] = (),
) -> DataFrame:
    """Indexes of the schemas by table, size band and kind, with size as text and bytes."""
    rows = in_schemas(index_relations(_of_method(cat, "btree") if kind == "btree" else cat), schemas, tool_schemas)
    rows = filter_size_gb(filter_index_kind(filter_table(rows, table), kind), min_gb, max_gb)
    return rows.withColumn("index_size", size_gb_text(F.col("size_bytes"))).select(
        *fleet_keys(rows), *INVENTORY_COLUMNS, F.lit(None).cast("string").alias("parent_table_name"), "index_oid",
        "table_oid", "schema_ord", F.col("schema_name").alias("listed_under"),
    )


def size_order(inventory: DataFrame, order: str | None = "asc") -> list[Column]:
    """Sort keys by size, nulls as 0; equal sizes keep list order (schema position, then name)."""
    size = F.coalesce("size_bytes", F.lit(0))
    by_size = size.desc() if parse_size_order(order) == "desc" else size.asc()
    return [by_size, *[F.asc(c) for c in ("schema_ord", "schema_name", "index_name") if c in inventory.columns]]


def order_by_size(inventory: DataFrame, order: str | None = "asc") -> DataFrame:
    """Global order by size, across all schemas."""
    return inventory.orderBy(*size_order(inventory, order))


def order_by_name(df: DataFrame) -> DataFrame:
    """Order by schema position, then index name (partitions: then size)."""
    keys = [c for c in ("schema_ord", "schema_name", "index_name", "partition_name", "size_bytes") if c in df.columns]
    return df.orderBy(*fleet_keys(df), *keys)


def _named_classes(cat: Catalog, relkind: str | None) -> DataFrame:
    """Relations of a kind, or all that are not indexes, with their schema name."""
    classes = _not_indexes(cat["class"]) if relkind is None else filter_relkind(cat["class"], relkind)
    named = _renamed(classes, oid="oid", relname="relname", namespace_oid="relnamespace")
    return _join(named, _renamed(cat["namespace"], namespace_oid="oid", schema_name="nspname"), "namespace_oid")


def table_partitions(
    cat: Catalog, schemas: str | Sequence[str] | None = None, table: str | None = None, tool_schemas: Sequence[str] = ()
) -> DataFrame:
    """Children of partitioned tables, with parent and child schema and name."""
    parents = in_schemas(_named_classes(cat, "p"), schemas, tool_schemas)
    if table is not None:
        parents = parents.filter(F.col("relname") == table)
    parents = _renamed(
        parents, inhparent="oid", parent_schema="schema_name", parent_table_name="relname", schema_ord="schema_ord"
    )
    children = within_ids(_named_classes(cat, None), "oid", cat["inherits"], "inhrelid")
    children = _renamed(children, inhrelid="oid", partition_schema="schema_name", partition_name="relname")
    pairs = _join(_join(_renamed(cat["inherits"], inhrelid="inhrelid", inhparent="inhparent"), parents, "inhparent"), children, "inhrelid")
    return pairs.select(
        *fleet_keys(pairs), "parent_schema", "parent_table_name", "partition_schema", "partition_name",
        F.col("inhrelid").alias("partition_oid"), "schema_ord",
    )


def partition_indexes(
    cat: Catalog, schemas: str | Sequence[str] | None = None, table: str | None = None, min_gb: int = 0,
    max_gb: int | None = None, tool_schemas: Sequence[str] = (),
) -> DataFrame:
    """Indexes of all partitions of the partitioned tables. Any access method, never a constraint."""
    parts = table_partitions(cat, schemas, table, tool_schemas)
    plain = within_ids(cat["index"], "indrelid", cat["inherits"], "inhrelid").filter(~F.col("indisprimary") & ~F.col("indisunique"))
    classes = within_ids(filter_relkind(cat["class"], "i"), "oid", plain, "indexrelid")
    plain = _renamed(plain, index_oid="indexrelid", partition_oid="indrelid")
    classes = filter_size_gb(classes, min_gb, max_gb, "relsize")
    classes = _renamed(classes, index_oid="oid", index_name="relname", am_oid="relam", size_bytes="relsize")
    rows = _join(_join(plain, parts, "partition_oid"), classes, "index_oid")
    rows = _join(rows, _renamed(cat["am"], am_oid="oid", index_type="amname"), "am_oid")
    return rows.select(
        *fleet_keys(rows), F.col("partition_schema").alias("schema_name"), F.col("partition_name").alias("table_name"),
        "index_name", size_gb_text(F.col("size_bytes")).alias("index_size"), "index_type", "size_bytes",
        "parent_table_name", "index_oid", F.col("partition_oid").alias("table_oid"), "schema_ord", F.col("parent_schema").alias("listed_under"),
    )


def partitioned_tables(
    cat: Catalog, schemas: str | Sequence[str] | None = None, tool_schemas: Sequence[str] = ()
) -> DataFrame:
    """Partitioned tables with their number of children, 0 kept.

    Children are counted before the join, so a table with very many costs nothing extra.
    """
    parents = in_schemas(_named_classes(cat, "p"), schemas, tool_schemas)
    inherits = cat["inherits"]
    counts = inherits.groupBy(*fleet_keys(inherits), F.col("inhparent").alias("oid")).agg(F.count(F.lit(1)).alias("n"))
    rows = _join(parents, counts, "oid", "left")
    return rows.select(
        *fleet_keys(rows), "schema_name", F.col("relname").alias("table_name"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("partition_count"), "schema_ord",
    )


def existence(cat: Catalog, schemas: str | Sequence[str], table: str | None = None) -> DataFrame:
    """Per listed schema: does it exist, does it hold the table, is the table partitioned with children."""
    wanted = schema_list(cat["namespace"].sparkSession, schemas)
    namespaces = cat["namespace"]
    lead = fleet_keys(namespaces)
    if lead:
        listed = F.array(*[F.struct(F.lit(r.schema_name).alias("schema_name"), F.lit(r.schema_ord).alias("schema_ord")) for r in wanted.collect()])
        wanted = namespaces.select(*lead).distinct().select(*lead, F.inline(listed))
    on = [*lead, "schema_name"]

    def flagged(rows: DataFrame, flag: str) -> DataFrame:
        return rows.select(*on).distinct().withColumn(flag, F.lit(True))

    named = F.col("relname") == F.lit(table)
    parents = _named_classes(cat, "p").filter(named)
    children = _renamed(cat["inherits"], oid="inhparent")
    parents = parents.join(children, [*fleet_keys(parents, children), "oid"], "left_semi")
    rows = wanted
    for part in (
        flagged(_renamed(namespaces, schema_name="nspname"), "schema_exists"),
        flagged(_named_classes(cat, "r").filter(named), "table_exists"),
        flagged(parents, "is_partitioned"),
    ):
        rows = rows.join(part, on, "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("schema_exists", "table_exists", "is_partitioned")]
    return rows.select(*on, "schema_ord", *flags)


def index_size(cat: Catalog, keys: DataFrame) -> DataFrame:
    """Size per (schema, index) of ``keys``; ``missing`` marks an index that was not found."""
    found = index_relations(cat, with_method=False, relkind=None, named=keys)
    on = index_keys(keys, found)
    rows = keys.join(found.select(*on, F.col("size_bytes").alias("current_size")), on, "left")
    return rows.select(*keys.columns, "current_size", F.col("current_size").isNull().alias("missing"))


def index_integrity(cat: Catalog, keys: DataFrame, by_table: bool = False, stored: bool = False) -> DataFrame:
    """``healthy`` per row of ``keys``: valid, ready and live; an unknown index is not.

    Keys with an ``index_oid`` need a single join; those by schema and name need the names of the catalog. ``by_table``: the
    keys name the table as well (``table_oid`` beside the id, ``table_name`` beside the names). What a snapshot has several
    times under one key is healthy if all of it is. Say ``stored`` when the keys come from a table.
    """
    if "index_oid" in keys.columns:
        found = _renamed(
            cat["index"], index_oid="indexrelid", table_oid="indrelid", is_valid="indisvalid", is_ready="indisready", is_live="indislive"
        )
        on = [*fleet_keys(keys, found), "index_oid", *(["table_oid"] if by_table else [])]
    else:
        found = index_relations(cat, with_method=False, named=keys, stored=stored)
        on = [*index_keys(keys, found), *(["table_name"] if by_table else [])]
    healthy = F.coalesce(F.col("is_valid") & F.col("is_ready") & F.col("is_live"), F.lit(False))
    rows = keys.join(found.groupBy(*on).agg(F.bool_and(healthy).alias("healthy")), on, "left")
    return rows.select(*keys.columns, F.coalesce("healthy", F.lit(False)).alias("healthy"))


def page_drift(cat: Catalog, schemas: str | Sequence[str] | None = None, tool_schemas: Sequence[str] = ()) -> DataFrame:
    """Gate bloat per index, joined by object id (equal names in other schemas do not mix)."""
    rows = in_schemas(index_relations(cat), schemas, tool_schemas)
    bloat = page_drift_bloat(F.col("index_pages"), F.col("table_pages"), F.col("size_bytes"), F.col("table_size"))
    return rows.select(
        *fleet_keys(rows), "schema_name", "table_name", "index_name", "index_oid", bloat.alias("bloat_percentage")
    )


def _fills_range(ids: DataFrame, column: str) -> bool:
    """Whether ids are at least half of the range they lie in, so that a cut to the range leaves few others."""
    low, high, n = ids.agg(F.min(column), F.max(column), F.count(column)).first()
    return low is not None and 2 * n > high - low


def before_snapshot(cat: Catalog, worklist: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """What a run knows about each index before it starts: size, health and gate bloat, in one pass.

    With a worklist (by ``index_oid``), only its indexes: index and class rows are reduced to them before they are joined.
    Without ``exact``, for a reader that joins the worklist anyway, they are reduced to its range of ids where it fills that.
    Index rows meet the tables first, so that nothing but ids, pages and flags is shuffled twice. Names of schemas and access
    methods are not looked up.
    """
    if worklist is not None:
        keyed = fleet_keys(worklist, cat["index"]) or fleet_keys(worklist, cat["class"])
        dense = not exact and not keyed and _fills_range(worklist, "index_oid")

        def listed(relation: str, oid: str) -> DataFrame:
            near = within_ids(cat[relation], oid, worklist, "index_oid")
            if dense:
                return near
            on = fleet_keys(cat[relation], worklist)
            wanted = worklist.select(*on, F.col("index_oid").alias(oid)).distinct()
            return near.join(wanted, [*on, oid], "left_semi")

        index = listed("index", "indexrelid")
        plain = _renamed(
            index, index_oid="indexrelid", table_oid="indrelid", is_valid="indisvalid", is_ready="indisready", is_live="indislive"
        )
        classes = _renamed(filter_relkind(listed("class", "oid"), "i"), index_oid="oid", size_bytes="relsize", index_pages="relpages")
        near = within_ids(cat["index"], "indexrelid", worklist, "index_oid")
        tables = within_ids(_not_indexes(cat["class"]), "oid", near, "indrelid")
        tables = _renamed(tables, table_oid="oid", table_pages="relpages", table_size="relsize")
        rows = _join(_join(plain, tables, "table_oid"), classes, "index_oid")
    else:
        rows = index_relations(cat)
    bloat = page_drift_bloat(F.col("index_pages"), F.col("table_pages"), F.col("size_bytes"), F.col("table_size"))
    healthy = F.col("is_valid") & F.col("is_ready") & F.col("is_live")
    return rows.select(
        *fleet_keys(rows), "index_oid", F.col("size_bytes").alias("before_size"),
        F.coalesce(healthy, F.lit(False)).alias("healthy_before"), bloat.alias("bloat_percentage"),
    )


def inventory_union(
    cat: Catalog, schemas: str | Sequence[str] | None = None, table: str | None = None, min_gb: int = 0,
    max_gb: int | None = None, kind: str = "btree", include_partitions: bool = False, tool_schemas: Sequence[str] = (),
) -> DataFrame:
    """Regular indexes, then the indexes of partitions, as one list with the ordinal ``pass``.

    Without a table both lists hold the indexes of partitions; ``dedupe_last_wins``
    keeps the row of the second. With a table, a schema where it is partitioned
    gives the indexes of its partitions only.
    """
    regular = index_inventory(cat, schemas, table, min_gb, max_gb, kind, tool_schemas).withColumn("pass", F.lit(0))
    if not include_partitions:
        return regular
    parts = partition_indexes(cat, schemas, table, min_gb, max_gb, tool_schemas).withColumn("pass", F.lit(1))
    if table is not None:
        split = table_partitions(cat, schemas, table, tool_schemas)
        on = [*fleet_keys(regular, split), "schema_name"]
        split = split.withColumnRenamed("parent_schema", "schema_name").select(*on).distinct()
        regular = regular.join(split, on, "left_anti")
    return regular.unionByName(parts, allowMissingColumns=True)


def dedupe_last_wins(inventory: DataFrame, order: Sequence[str] = ("schema_ord", "listed_under", "pass")) -> DataFrame:
    """One row per (schema, index): the last in list order.

    The list goes schema by schema, regular indexes before those of partitions.
    An aggregate, not a window: copies of one key already meet on the map side.
    """
    keys = index_keys(inventory)
    rest = [c for c in inventory.columns if c not in keys]
    last = inventory.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return last.select(*keys, *[F.col("last")[c].alias(c) for c in rest]).select(*inventory.columns)


def temp_rebuild_candidates(cat: Catalog, inventory: DataFrame) -> DataFrame:
    """Leftover indexes of concurrent rebuilds with their health."""
    left = inventory.filter(is_temp_rebuild_name(F.col("index_name")))
    return index_integrity(cat, left, by_table="table_oid" in inventory.columns)
