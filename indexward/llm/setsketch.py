"""Near-duplicates by SetSketch registers.

Every shingle of a text yields exponentially spaced values for registers in
pseudo-random order; a register keeps the least value, truncated to a small
exponent. Registers merge by the maximum of their exponents, and two sets agree
in a register about as often as their Jaccard likeness. Bands of equal registers
give candidates, a joint likelihood of the registers estimates them, and the
full shingle sets decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexward.sources.scratch import hadoop_path, scratch_path

from .common import Batches, broadcast_checked, free_name, remembers, slices

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Word hashes that a Python process remembers; bounds memory only.
REMEMBERED = 300_000
#: Buckets of at most SMALL sets give all their pairs. Larger ones are compared CHUNK sets against CHUNK sets in Python.
SMALL, CHUNK = 12, 512
#: Links that are grouped in one task; more go over tables.
SMALL_GRAPH = 1_000_000
_words: dict[bytes, int] = {}


@dataclass(frozen=True)
class Sketch:
    """Parameters: registers, base of the exponents, rate, bands of ``rows`` registers.

    With the defaults, two sets of likeness 0.8 agree in no band with probability 2e-6 (0.85: 1e-9) if registers are independent,
    which those of a few elements are only nearly.
    """

    m: int = 256
    base: float = 1.08
    rate: float = 20.0
    bands: int = 42
    rows: int = 6

    def error(self, likeness: float) -> float:
        """Standard error of an estimate."""
        return (likeness * (1 - likeness) / self.m) ** 0.5


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``words`` words of a text.

    A-Z count as a-z, words are cut at spaces and the characters 9 to 13. A text of fewer words is one shingle, one without
    words (or null) has none.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join([b"", *parts]))], np.uint64)
    if len(_words) > REMEMBERED:
        _words.clear()
    for w in parts:
        if w not in _words:
            _words[w] = xxhash.xxh64_intdigest(w)
    h = np.array([_words[w] for w in parts], np.uint64)
    n = len(h) - words + 1
    out = _mixed(h[:n])
    for k in range(1, words):
        out = _mixed(out * _A + h[k : n + k])
    return np.unique(out)


def _place(j: int, seed: np.ndarray, m: int) -> np.ndarray:
    """The register that the elements take in step ``j``: a pseudo-random permutation of ``range(m)`` (a power of two) for each seed."""
    part, mask, half = seed.view(np.uint16).reshape(-1, 4), np.uint16(m - 1), np.uint16(m.bit_length() // 2)
    x = np.full(len(seed), j, np.uint16)
    for k in range(4):
        x = (x * (part[:, k] | np.uint16(1)) + part[:, (k + 1) % 4]) & mask
        x = x ^ (x >> half)
    return x.astype(np.int64)


def registers(sets: list[np.ndarray], p: Sketch) -> np.ndarray:
    """Exponents of the registers, one row per set; a set without elements has zeros."""
    n, m = len(sets), p.m
    least = np.full(n * m, np.inf)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    element = np.concatenate([*sets, np.zeros(0, np.uint64)])
    value, seed = np.zeros(len(element)), _mixed(element ^ _A)
    for j in range(m):
        if not len(element):
            break
        u = ((_mixed(seed + np.uint64(j) * _A) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        value = value - np.log(u) / (p.rate * (m - j))
        np.minimum.at(least, owner * m + _place(j, seed, m), value)
        on = value < least.reshape(n, m).max(axis=1)[owner]  # larger values cannot lower any register
        element, owner, value, seed = element[on], owner[on], value[on], seed[on]
    with np.errstate(divide="ignore"):
        return np.where(np.isinf(least), 0, np.clip(np.floor(1 - np.log(least) / np.log(p.base)), 0, 255)).astype(np.uint8).reshape(n, m)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def likely(above: np.ndarray, below: np.ndarray, m: int, size_a: np.ndarray, size_b: np.ndarray, base: float) -> np.ndarray:
    """Likeness of greatest joint likelihood, from the numbers of registers in which a is above and below b and both sizes."""
    u = (size_a / np.maximum(1, size_a + size_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12))

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)

    up, down = p(u - v * j), p(v - u * j)
    equal = np.maximum(1 - up - down, 1e-12)
    up, down = np.maximum(up, 1e-12), np.maximum(down, 1e-12)
    a, b = above[:, None], below[:, None]
    best = (a * np.log(up) + b * np.log(down) + (m - a - b) * np.log(equal)).argmax(axis=1)
    return j[np.arange(len(best)), best]


def likely_at_least(above: np.ndarray, below: np.ndarray, m: int, size_a: np.ndarray, size_b: np.ndarray, base: float, least: float) -> np.ndarray:
    """Whether the likeness of greatest joint likelihood is at least ``least``: the likelihood still grows there."""
    u = size_a / np.maximum(1, size_a + size_b)
    v = 1 - u
    shrink, scale = (base - 1) / base, np.log(base)

    def p(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-np.clip(x, 0, 1) * shrink) / scale, 1e-12)

    def slope(x: np.ndarray) -> np.ndarray:
        return shrink / (1 - np.clip(x, 0, 1) * shrink) / scale

    x, y = u - v * least, v - u * least
    up, down, by_up, by_down = p(x), p(y), v * slope(x), u * slope(y)
    growth = (m - above - below) * (by_up + by_down) / np.maximum(1 - up - down, 1e-12) - above * by_up / up - below * by_down / down
    return (growth >= 0) & (x >= 0) & (y >= 0)


def _key(text: str) -> Column:
    """Hash of a text; with the id it names a row, also where an id is null or stands on several texts."""
    return F.xxhash64(F.col(text).cast("string"))


def _sketches(docs: DataFrame, doc_id: str, text: str, words: int, p: Sketch) -> DataFrame:
    """``id, key, node, n, sketch``: ``node`` is a hash of the set, 0 for an empty one."""
    picked = docs.select(F.col(doc_id).alias("id"), _key(text).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Batches) -> Batches:
        remembers("setsketch", _words.clear)
        for batch in slices(batches):
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            node = [(xxhash.xxh3_64_intdigest(s.tobytes()) >> 1) or 1 if len(s) else 0 for s in sets]
            sketch = [r.tobytes() for r in registers(sets, p)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), pa.array(node, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sketch, pa.binary())],
                ["id", "key", "node", "n", "sketch"],
            )

    return picked.mapInArrow(run, f"id {dict(picked.dtypes)['id']}, key bigint, node bigint, n bigint, sketch binary")


def _buckets(nodes: DataFrame, p: Sketch) -> DataFrame:
    """``bucket, node, n`` for every band of every set."""

    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            r = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, p.m)
            wide = np.zeros((len(r), p.bands, 8), np.uint8)
            wide[:, :, : p.rows] = r[:, : p.bands * p.rows].reshape(-1, p.bands, p.rows)
            bucket = (wide.view("<u8")[:, :, 0] | (np.arange(p.bands, dtype=np.uint64) << np.uint64(50))[None, :]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.ravel()), pa.array(np.repeat(batch.column("node").to_numpy(), p.bands)), pa.array(np.repeat(batch.column("n").to_numpy(), p.bands))],
                ["bucket", "node", "n"],
            )

    return nodes.select("node", "n", "sketch").mapInArrow(run, "bucket bigint, node bigint, n bigint")


class Tables:
    """Intermediate tables of one run, by name; a table that is written again replaces the older one, which is removed."""

    def __init__(self, df: DataFrame):
        self.spark, self.paths = df.sparkSession, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path, old = scratch_path(self.spark, name), self.paths.get(name)
        df.write.parquet(path)
        self.paths[name] = path
        if old:
            self._remove(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                self._remove(self.paths.pop(name))

    def _remove(self, path: str) -> None:
        location, files = hadoop_path(self.spark, path)
        files.delete(location, True)


def _estimated(pairs: DataFrame, nodes: DataFrame, p: Sketch, least: float) -> DataFrame:
    """The pairs ``a, b`` whose registers make at least ``least`` likely."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Batches) -> Batches:
        for batch in slices(batches, 4096):
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, p.m) for c in ("sa", "sb"))
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            keep = likely((ra > rb).sum(axis=1), (ra < rb).sum(axis=1), p.m, na, nb, p.base) >= least
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return joined.mapInArrow(run, "a bigint, b bigint")


def _dealt(rows: DataFrame, chunk: int) -> DataFrame:
    """Rows ``bucket, node, comp`` dealt to pieces ``bucket, i, j`` in which each pair of different components meets once.

    The largest component of a bucket is cut into chunks, and so are all other rows. Chunks of the largest meet chunks of the
    others, and chunks of the others meet each other: rows of the largest component are repeated once per chunk of the others,
    and never among themselves. ``side`` 0 meets side 1 in a piece; a chunk that meets itself has side 2.
    """
    sizes = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k"))
    sizes = sizes.groupBy("bucket").agg(F.max_by("comp", "k").alias("most"), F.max("k").alias("inside"), F.sum("k").alias("all"))
    placed = rows.join(sizes, "bucket")
    parts = lambda count: F.greatest(F.lit(1), F.ceil(count / F.lit(chunk)).cast("int"))
    placed = placed.withColumns({"first": F.col("comp") == F.col("most"), "a": parts(F.col("inside")), "b": parts(F.col("all") - F.col("inside"))})
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("node"), F.when(F.col("first"), F.col("a")).otherwise(F.col("b"))).cast("int"))
    # The chunks of the largest component are numbered 0..a-1, those of the others a..a+b-1.
    others = F.sequence(F.col("a"), F.col("a") + F.col("b") - 1)
    own = F.col("a") + F.col("mine")
    to = F.when(
        F.col("first"), F.transform(others, lambda j: F.struct(F.col("mine").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    ).otherwise(F.concat(
        F.transform(F.sequence(F.lit(0), F.col("a") - 1), lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(1).alias("side"))),
        F.transform(others, lambda j: F.struct(
            F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), F.when(j == own, 2).when(own < j, 0).otherwise(1).alias("side")
        )),
    ))
    return placed.select("bucket", "node", "comp", F.explode(to).alias("to")).select("bucket", "to.i", "to.j", "to.side", "node", "comp")


def _with_partner(t: pa.Table, p: Sketch, share: tuple[int, int], least: float) -> np.ndarray:
    """The rows of a piece that have a likely partner in another component."""
    per, of = share
    n, comp, side = (t.column(c).to_numpy() for c in ("n", "comp", "side"))
    r = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, p.m)
    alone = side.max() == 2
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not alone and len(left) > len(right):
        left, right = right, left
    have = np.zeros(len(n), bool)
    for k in left:
        near = right[right > k] if alone else right
        near = near[(comp[near] != comp[k]) & (of * np.minimum(n[near], n[k]) >= per * np.maximum(n[near], n[k]))]
        if len(near):
            above, below = (r[k] > r[near]).sum(axis=1), (r[k] < r[near]).sum(axis=1)
            good = likely_at_least(above, below, p.m, np.full(len(near), float(n[k])), n[near].astype(float), p.base, least)
            have[near[good]] = True
            have[k] |= good.any()
    return np.flatnonzero(have)


def common_items(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of sets, ``left`` by ``right``: items that several sets have are columns of 0 and 1, multiplied in parts."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column, shared = column.ravel(), uses > 1
    place = np.cumsum(shared) - 1
    owner, column = owner[shared[column]], place[column[shared[column]]]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    out = np.zeros((len(left), len(right)), np.float32)  # exact: sizes stay far below 2 ** 24
    for start in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        out += part[left] @ part[right].T
    return out.astype(np.int64)


def _pieces(rows: DataFrame) -> DataFrame:
    """The rows with every piece in one place; dealt by number, since pieces are small and long work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket", "i", "j")


def _likely_rows(rows: DataFrame, nodes: DataFrame, p: Sketch, share: tuple[int, int], least: float) -> DataFrame:
    """The rows of all pieces (``rows``: ``bucket, node, comp``) that have a likely partner in another component."""

    def partners(t: pa.Table) -> pa.Table:
        return t.select(["bucket", "i", "j", "side", "node", "comp"]).take(pa.array(_with_partner(t, p, share, least), pa.int64()))

    return _pieces(_dealt(rows, CHUNK).join(nodes, "node")).groupBy("bucket", "i", "j").applyInArrow(
        partners, "bucket bigint, i int, j int, side int, node bigint, comp bigint"
    )


def _across(rows: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links between different components that meet in pieces; ``rows`` as ``_likely_rows`` gives them.

    The full sets decide all pairs of different components of a piece at once. One link for each pair of components that has
    any is returned, so the others are not needed to connect them.
    """
    per, of = share

    def links(t: pa.Table) -> pa.Table:
        node, comp, side = (t.column(c).to_numpy() for c in ("node", "comp", "side"))
        items = [s.values.to_numpy() for s in t.column("items")]
        n = np.array([len(s) for s in items])
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        common = common_items(items, left, right)
        linked = (of * common >= per * (n[left][:, None] + n[right][None, :] - common)) & (comp[left][:, None] != comp[right][None, :])
        x, y = np.nonzero(linked)
        x, y = left[x], right[y]
        pairs = np.stack([np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])], axis=1)
        _, first = np.unique(pairs, axis=0, return_index=True) if len(pairs) else (None, np.zeros(0, np.int64))
        a, b = node[x[first]], node[y[first]]
        return pa.table([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

    wide = _pieces(rows.join(sets, "node"))
    return wide.groupBy("bucket", "i", "j").applyInArrow(links, "a bigint, b bigint").distinct()


def _grouped_buckets(rows: DataFrame, tables: Tables) -> DataFrame:
    """Rows ``bucket, node, comp`` of large buckets, with one group in place of many buckets where that is less work.

    A family of like sets that are no links meets again in many bands. Buckets that share sets are one group; its sets are
    compared once, all with all, if they make fewer pairs than the buckets of the group do together. Negative numbers name
    groups.
    """
    hubs = rows.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size"))
    edges = rows.join(hubs, "bucket").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    grouped = components(edges, tables, "bucket-groups").withColumnRenamed("comp", "grp")
    of_hub = grouped.select(F.col("node").alias("hub"), "grp")
    work = hubs.join(of_hub, "hub").select("bucket", "grp", (F.col("size").cast("double") * F.col("size")).alias("pairs"))
    apart = work.groupBy("grp").agg(F.sum("pairs").alias("apart"))
    together = grouped.groupBy("grp").agg(F.count(F.lit(1)).cast("double").alias("n")).join(apart, "grp").where("n * n <= apart").select("grp")
    named = tables.write(work.join(together.withColumn("whole", F.lit(True)), "grp", "left").select("bucket", "grp", "whole"), "bucket-names")
    placed = rows.join(named, "bucket")
    return placed.select(F.when(F.col("whole"), -F.col("grp")).otherwise(F.col("bucket")).alias("bucket"), "node", "comp").distinct()


def _linked(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs with ``of * intersection >= per * union`` of the full sets."""
    per, of = share
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(of * common >= per * (F.size("x") + F.size("y") - common)).select("a", "b")


def _reached(batches: Batches) -> Batches:
    """``node, comp`` of all edges ``u, v`` at hand: nodes hang themselves to the smallest root they meet until nothing changes."""
    tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not tables:
        return
    u, v = (np.concatenate([t.column(c).to_numpy() for t in tables]) for c in ("u", "v"))
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place.ravel()[: len(u)], place.ravel()[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        if (x == y).all():
            break
        np.minimum.at(root, x, y)
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "comp"])


def components(edges: DataFrame, tables: Tables | None = None, name: str = "components") -> DataFrame:
    """``node, comp`` for the nodes of ``edges`` (``a, b``): the smallest node that can be reached.

    Alternating large and small stars: nodes hang themselves to the smallest neighbour until nothing changes. Each round is
    written to a table and the one before removed; nothing is collected but one sum. Up to ``SMALL_GRAPH`` edges (some 16 MB)
    are worked in one task instead, with the same result.
    """
    tables = tables or Tables(edges)
    now = tables.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    if now.count() <= SMALL_GRAPH:
        full = tables.write(now.coalesce(1).mapInArrow(_reached, "node bigint, comp bigint"), name)
        tables.drop("edges")
        return full
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = tables.write(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    full = now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
    full = tables.write(full, name)
    tables.drop("edges")
    return full


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, share: tuple[int, int] = (80, 100), sketch: Sketch | None = None,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``.

    Documents are linked if ``share[1] * intersection >= share[0] * union`` of their shingle sets; ``component_id`` is the
    smallest id that can be reached over links, ``kept`` marks the rows with that id. Equal sets are one node from the start,
    so copies are never paired. Documents without words are linked with nothing and kept. Null ids take part, but name no
    component unless all ids of it are null. Rows that repeat an id stay rows of their own.
    """
    return _grouped(docs, doc_id, text, words, share, sketch).drop("key")


def _grouped(
    docs: DataFrame, doc_id: str, text: str, words: int = 5, share: tuple[int, int] = (80, 100), sketch: Sketch | None = None,
    tables: Tables | None = None,
) -> DataFrame:
    """As ``near_duplicates``, with ``key``, the hash of the text.

    1. Stars: in every bucket of equal bands each set is held against one hub, first the smallest node, then, where a bucket
       still has several components, the largest. Few distinct pairs join most of a family of near copies.
    2. What is left: buckets that still have several components. Sets of different components are compared there, all pairs
       of small buckets, and large ones piece by piece: likely sets by their registers, then all of these at once.
    """
    p = sketch or Sketch()
    per, of = share
    least = per / of - 4.5 * p.error(per / of)
    tables = tables or Tables(docs)
    all_rows = tables.write(_sketches(docs, doc_id, text, words, p), "sketches")
    # One row per distinct set: equal sets have equal sketches.
    nodes = tables.write(all_rows.where("node <> 0").groupBy("node").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch")), "nodes")
    rows = _buckets(nodes, p)
    hubs = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub"), F.min_by("n", "node").alias("hub_n")).where("size > 1")
    members = tables.write(rows.join(hubs, "bucket"), "bucket-members")

    def near(a: str, b: str) -> str:
        return f"{of} * least({a}, {b}) >= {per} * greatest({a}, {b})"

    row = F.xxhash64("id", "key")

    def full_sets(wanted: DataFrame) -> DataFrame:
        """``node, items`` for the nodes: each from one row that has it, found by the hash of its id and text."""
        chosen = all_rows.join(broadcast_checked(tables.write(wanted.distinct(), "wanted")), "node", "left_semi").groupBy("node").agg(F.min(row).alias("_row"))
        chosen = tables.write(chosen.select("_row").distinct(), "wanted-rows")
        texts = docs.select(F.col(doc_id).alias("id"), _key(text).alias("key"), F.col(text).cast("string").alias("text"))
        texts = texts.withColumn("_row", row).join(broadcast_checked(chosen), "_row", "left_semi").select("text")

        def full(batches: Batches) -> Batches:
            remembers("setsketch", _words.clear)
            for batch in slices(batches):
                sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
                node = [(xxhash.xxh3_64_intdigest(s.tobytes()) >> 1) or 1 if len(s) else 0 for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "items"])

        return texts.mapInArrow(full, "node bigint, items array<bigint>").dropDuplicates(["node"])

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))

    def decided(pairs: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The links among likely pairs, and the full sets known then."""
        wanted = ends(pairs) if known is None else ends(pairs).join(known.select("node"), "node", "left_anti")
        sets = full_sets(wanted) if known is None else full_sets(wanted).unionByName(known)
        sets = tables.write(sets, "sets")
        return _linked(pairs, sets, share), sets

    # Stars.
    star = members.where(f"node <> hub AND {near('n', 'hub_n')}").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    pairs = tables.write(_estimated(star, nodes, p, least), "pairs")
    links, sets = decided(pairs, None)
    links = tables.write(links, "links")
    found = components(links, tables)

    def live() -> DataFrame:
        """Members of the buckets that still hold several components."""
        mixed = members.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        split = mixed.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("node").alias("last")).where("x <> y").drop("x", "y")
        return tables.write(mixed.join(split, "bucket").select("bucket", "size", "node", "n", "comp", "last"), "live-members")

    mixed = live()
    if not mixed.isEmpty():
        last = mixed.where("node = last").select("bucket", F.col("n").alias("last_n"), F.col("comp").alias("last_comp"))
        star = mixed.join(last, "bucket").where(f"comp <> last_comp AND {near('n', 'last_n')}").select(F.col("node").alias("a"), F.col("last").alias("b")).distinct()
        pairs = tables.write(_estimated(star.join(links, ["a", "b"], "left_anti"), nodes, p, least), "pairs")
        more, sets = decided(pairs, sets)
        links = tables.write(links.unionByName(more), "links")
        found = components(links, tables)
        mixed = live()

    # What is left.
    if not mixed.isEmpty():
        small = mixed.where(F.col("size") <= SMALL)
        left, right = (small.select("bucket", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("comp").alias(f"c{x}")) for x in ("a", "b"))
        few = left.join(right, "bucket").where(f"a < b AND ca <> cb AND {near('na', 'nb')}").select("a", "b").distinct()
        large = _grouped_buckets(mixed.where(F.col("size") > SMALL).select("bucket", "node", "comp"), tables)
        pairs = tables.write(_estimated(few, nodes, p, least), "pairs")
        large = tables.write(_likely_rows(large, nodes, p, share, least), "likely-rows")
        wanted = ends(pairs).unionByName(large.select("node")).join(sets.select("node"), "node", "left_anti")
        sets = tables.write(full_sets(wanted).unionByName(sets), "sets")
        more = _linked(pairs, sets, share).unionByName(_across(large, sets, share))
        links = tables.write(links.unionByName(more).distinct(), "links")
        found = components(links, tables)

    named = all_rows.where("node <> 0").groupBy("node").agg(F.min("id").alias("id")).join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    of_node = tables.write(named.join(names, "comp").select("node", "component_id"), "names")
    tables.drop("nodes", "bucket-members", "wanted", "wanted-rows", "pairs", "sets", "links", "live-members", "likely-rows", "bucket-groups", "bucket-names", "components")
    out = all_rows.select("id", "key", "node", "n").join(of_node, "node", "left")
    component = F.when(F.col("node") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "key")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group, with all columns of ``docs``: the one with the smallest id.

    Rows that repeat the kept id all stay if their texts are of the group, and so do rows with a null id. Rows go by id and
    text: other texts under the same id stay.
    """
    name, key = free_name(docs, "_lost"), free_name(docs, "_lost_key")
    tables = Tables(docs)
    rows = _grouped(docs, doc_id, text, tables=tables, **options).where("NOT kept AND doc_id IS NOT NULL")
    lost = broadcast_checked(tables.write(rows.select(F.col("doc_id").alias(name), F.col("key").alias(key)).distinct(), "lost"))
    tables.drop("sketches", "names")
    return docs.join(lost, (F.col(doc_id) == F.col(name)) & (_key(text) == F.col(key)), "left_anti")


NEAR_SQL = r"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + k - 1], ' ')) AS x
  FROM (SELECT doc_id, w, least(3, len(w)) AS k, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM t WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS id, a AS low FROM e UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.id),
m AS (SELECT id, min(low) AS low FROM r GROUP BY id)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.low, t.doc_id) AS component_id,
  t.doc_id = coalesce(m.low, t.doc_id) AS kept
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN m ON m.id = t.doc_id
"""
