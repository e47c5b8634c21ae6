"""Merkle manifest of a table: one tree per group of rows, one tree over the groups, and a proof for every row.

Time-forward processing: nodes are labelled so that children come before their
parent, a priority queue ordered by label delivers the digests of children to
parents, and a sweep in reversed order delivers to each child the siblings of its
own run followed by what its parent got. Inside a task the queue holds at most a
run per level. What has to wait longer lies in written tables and is delivered by
a shuffle: the rows of a group are cut into blocks of consecutive leaves, a block
sends one digest upwards and receives one proof suffix, so a group of any size is
spread over all tasks.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexward.operators.ranking import number_in_groups
from indexward.sources.scratch import materialize

from .common import Batches, free_name

#: Children of a node, and levels that are worked in one block of FAN ** HEIGHT nodes.
FAN, HEIGHT = 3, 6

_NODE = "grp string, n bigint, pos bigint, digest string"


def digest(*inputs: str) -> str:
    """Lowercase hex SHA-256 of the inputs one after the other."""
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf_of(columns: Sequence[Column]) -> Column:
    """Digest of a row: each value as ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    def part(column: Column) -> Column:
        text = column.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in columns]).cast("binary"), 256)


def levels_of(n: int, fan: int = FAN) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fan), levels + 1
    return levels


def sweep_up(digests: Iterable[str], size: int, levels: int, fan: int = FAN) -> Iterator[tuple[int, str]]:
    """``(level, digest)`` of all nodes above ``size`` consecutive nodes, children before parents.

    The label of a node is the last node below it and its level. Messages wait in a priority queue until the sweep has come
    that far, so the queue holds fewer than ``fan`` messages per level.
    """
    queue: list[tuple[int, int, int, str]] = []

    def send(level: int, index: int, value: str) -> None:
        end = min((index // fan + 1) * fan ** (level + 1), size) - 1
        heapq.heappush(queue, (end, level + 1, index, value))

    for at, value in enumerate(digests):
        yield 0, value
        if levels:
            send(0, at, value)
        while queue and queue[0][0] <= at:
            end, level, index, value = heapq.heappop(queue)
            inputs = [value]
            while queue and queue[0][:2] == (end, level):
                inputs.append(heapq.heappop(queue)[3])
            value = digest(*inputs)
            yield level, value
            if level < levels:
                send(level, index // fan, value)


def sweep_down(by_level: list[list[str]], top: tuple, fan: int = FAN) -> list[tuple]:
    """Proofs of the lowest nodes, from the nodes of all levels and the proof of the one on top.

    A proof is ``(before, after, proof of the parent)``: the joined siblings to the left and to the right in the node's run.
    """
    proofs = [top]
    for nodes in reversed(by_level[:-1]):
        lower = []
        for i in range(len(nodes)):
            start = i - i % fan
            lower.append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + fan]), proofs[i // fan]))
        proofs = lower
    return proofs


def _block(nodes: DataFrame, fan: int, height: int) -> Column:
    return F.floor(F.col("pos") / F.lit(fan**height)).cast("bigint")


def _rise(nodes: DataFrame, fan: int, height: int) -> DataFrame:
    """The nodes ``height`` levels up (or the single top of a group that ends earlier)."""
    width = fan**height
    dealt = nodes.select("grp", "n", "pos", "digest", _block(nodes, fan, height).alias("block")).repartition("grp", "block")

    def run(batches: Batches) -> Batches:
        def runs() -> Iterator[tuple[tuple, Iterator[str]]]:
            at, digests = None, []
            for batch in batches:
                for grp, n, block, value in zip(*(batch.column(c).to_pylist() for c in ("grp", "n", "block", "digest"))):
                    if (grp, block, n) != at:
                        if at is not None:
                            yield at, digests
                        at, digests = (grp, block, n), []
                    digests.append(value)
            if at is not None:
                yield at, digests

        out: list[tuple] = []

        def rows() -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], ["grp", "n", "pos", "digest"])

        for (grp, block, n), digests in runs():
            *_, (_, value) = sweep_up(digests, len(digests), min(height, levels_of(n, fan)), fan)
            out.append((grp, -(-n // width), block, value))
            if len(out) >= 4096:
                yield rows()
                out = []
        if out:
            yield rows()

    return dealt.sortWithinPartitions("grp", "block", "pos").mapInArrow(run, _NODE)


def _tree(nodes: DataFrame, fan: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each round, lowest first, and ``grp, digest, round``: the top of each group and the round that ends it."""
    rounds, tops, now = [nodes], None, nodes
    while True:
        up = materialize(_rise(now, fan, height), "merkle-nodes")
        ended = up.where("n = 1").select("grp", "digest", F.lit(len(rounds) - 1).alias("round"))
        tops = ended if tops is None else tops.unionByName(ended)
        now = up.where("n > 1")
        if now.isEmpty():
            return rounds, tops
        rounds.append(now)


def _proofs(nodes: DataFrame, messages: DataFrame, carried: Sequence[str], fan: int, height: int) -> DataFrame:
    """``grp, pos, digest, before, after, top`` and ``carried`` per node, from one message per block.

    ``messages`` has ``grp, block, before, after, top``: the proof of the node in which the block ends, and a text for all
    nodes below it.
    """
    block = _block(nodes, fan, height).alias("block")
    mine = nodes.select("grp", block, "n", "pos", "digest", *carried)
    dealt = mine.unionByName(messages, allowMissingColumns=True).repartition("grp", "block").sortWithinPartitions("grp", "block", F.asc_nulls_first("pos"))
    kinds = ", ".join([*(f"`{c}` {dict(nodes.dtypes)[c]}" for c in carried)])
    schema = "grp string, pos bigint, digest string, before array<string>, after array<string>, top string" + (f", {kinds}" if carried else "")
    types = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
    names = ["grp", "pos", "digest", "before", "after", "top", *carried]

    def run(batches: Batches) -> Batches:
        at, rows, head = None, [], None
        kept_types: list[pa.DataType] = []

        def proved() -> pa.RecordBatch:
            by_level: list[list[str]] = [[] for _ in range(min(height, levels_of(rows[0][0], fan)) + 1)]
            for level, value in sweep_up([r[2] for r in rows], len(rows), len(by_level) - 1, fan):
                by_level[level].append(value)
            top: tuple = ()
            for before, after in zip(reversed(head[0]), reversed(head[1])):
                top = (before, after, top)
            out = []
            for (_, pos, value, *kept), proof in zip(rows, sweep_down(by_level, top, fan)):
                before, after = [], []
                while proof:
                    before.append(proof[0])
                    after.append(proof[1])
                    proof = proof[2]
                out.append((at[0], pos, value, before, after, head[2], *kept))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), [*types, *kept_types])], names)

        for batch in batches:
            kept_types = [batch.column(c).type for c in carried]
            columns = ("grp", "block", "before", "after", "top", "n", "pos", "digest", *carried)
            for grp, block, before, after, text, *row in zip(*(batch.column(c).to_pylist() for c in columns)):
                if (grp, block) != at:
                    if rows:
                        yield proved()
                    at, rows = (grp, block), []
                if row[1] is None:
                    head = (before, after, text)
                else:
                    rows.append(row)
        if rows:
            yield proved()

    return dealt.mapInArrow(run, schema)


def _descend(rounds: list[DataFrame], ends: DataFrame, carried: Sequence[str], fan: int, height: int) -> DataFrame:
    """Proofs of the lowest nodes of all groups. ``ends`` has ``grp, round, before, after, top`` for the top of each group."""
    messages = None
    for k in reversed(range(len(rounds))):
        to_groups = ends.where(F.col("round") == k).select("grp", F.lit(0).cast("bigint").alias("block"), "before", "after", "top")
        messages = to_groups if messages is None else messages.unionByName(to_groups)
        found = _proofs(rounds[k], messages, [] if k else carried, fan, height)
        if not k:
            return found
        messages = materialize(found.select("grp", F.col("pos").alias("block"), "before", "after", "top"), "merkle-messages")


def manifest(
    docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", order: str = "doc_id",
    carry: dict[str, Column] | None = None, fan: int = FAN, height: int = HEIGHT,
) -> DataFrame:
    """``doc_id, source, position, leaf, subroot, root, before, after`` and ``carry`` per row of ``docs``.

    The leaves of a group ascend by ``order``; consecutive runs of ``fan`` nodes become their parent until one is left, the
    subroot (a lone leaf itself). Subroots in order of their group (null first, by bytes) likewise give the root. ``before``
    and ``after`` hold for each level, from the leaf to the root, the digests left and right of the node in its run, joined;
    with them ``fold_proof`` computes the root from a leaf. ``carry`` adds further columns, computed from ``docs``.

    Null values have a leaf of their own form, null groups are a group, null ids come first. Rows with equal ids are ordered
    by their digest; equal rows are equal leaves. An empty table gives no rows. Other columns do not matter.
    """
    carry = carry or {}
    key, at = F.col(order), dict(docs.dtypes)
    leaves = docs.select(
        key.alias("id"), F.col(group).cast("string").alias("grp"), leaf_of([F.col(c) for c in columns]).alias("digest"), *[c.alias(f"_{n}") for n, c in carry.items()]
    )
    carried = ["id", *(f"_{n}" for n in carry)]
    placed = number_in_groups(materialize(leaves, "merkle-leaves"), ["grp"], ["id", "digest"], "pos", "n")
    leaves = materialize(placed.withColumn("pos", F.col("pos") - 1), "merkle-leaves")
    rounds, tops = _tree(leaves, fan, height)

    # The tops of the groups are the leaves of one more tree, whose only group is the empty text.
    tops = materialize(tops, "merkle-tops")
    over = number_in_groups(tops.select(F.lit("").alias("all"), "grp", "digest", "round"), ["all"], ["grp"], "pos", "n")
    over = materialize(
        over.select(F.lit("").alias("grp"), "n", (F.col("pos") - 1).alias("pos"), "digest", F.col("grp").alias("name"), "round"), "merkle-tops"
    )
    over_rounds, root = _tree(over, fan, height)
    none = F.array().cast("array<string>")
    start = root.select("grp", "round", none.alias("before"), none.alias("after"), F.col("digest").alias("top"))
    ends = _descend(over_rounds, start, ["name", "round"], fan, height)
    # Below, the text that goes to all rows of a group is its subroot and the root.
    ends = materialize(
        ends.select(F.col("name").alias("grp"), "round", "before", "after", F.concat_ws(" ", "digest", "top").alias("top")), "merkle-ends"
    )
    found = _descend(rounds, ends, carried, fan, height)
    return found.select(
        F.col("id").cast(at[order]).alias("doc_id"), F.col("grp").alias("source"), F.col("pos").alias("position"), F.col("digest").alias("leaf"),
        F.substring_index("top", " ", 1).alias("subroot"), F.substring_index("top", " ", -1).alias("root"), "before", "after",
        *[F.col(f"_{n}").alias(n) for n in carry],
    )


def siblings(before: str = "before", after: str = "after") -> Column:
    """All siblings of a proof, joined, level by level and from left to right."""
    return F.array_join(F.zip_with(before, after, lambda b, a: F.concat(b, a)), "")


def fold_proof(leaf: Column, before: str = "before", after: str = "after") -> Column:
    """The root that a leaf and the siblings of a proof give."""
    steps = F.arrays_zip(F.col(before).alias("before"), F.col(after).alias("after"))
    return F.aggregate(steps, leaf, lambda now, s: F.sha2(F.concat(s["before"], now, s["after"]).cast("binary"), 256))


def without_line_breaks(text: str) -> Column:
    """A text with its line feeds deleted."""
    return F.translate(F.col(text), "\n", "")


def verify(docs: DataFrame, proofs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), order: str = "doc_id") -> DataFrame:
    """``docs`` as they are now against the proofs of an earlier ``manifest``: ``doc_id, leaf, folded_root, verified``.

    Rows go by id; an id without a proof is not verified, and repeated ids are held against each proof of that id and are
    verified if one fits. Null ids go together.
    """
    name = free_name(docs, "_id")
    now = docs.select(F.col(order).alias(name), leaf_of([F.col(c) for c in columns]).alias("leaf"))
    kept = proofs.select(F.col("doc_id").alias("_of"), "root", "before", "after", F.lit(True).alias("_there"))
    pairs = now.join(kept, F.col(name).eqNullSafe(F.col("_of")), "left")
    folded = pairs.select(F.col(name).alias("doc_id"), "leaf", F.when(F.col("_there"), fold_proof(F.col("leaf"))).alias("folded_root"), "root")
    best = folded.groupBy("doc_id", "leaf").agg(
        F.max_by("folded_root", F.coalesce(F.col("folded_root") == F.col("root"), F.lit(False))).alias("folded_root"),
        F.max(F.coalesce(F.col("folded_root") == F.col("root"), F.lit(False))).alias("verified"),
    )
    return best.select("doc_id", "leaf", "folded_root", "verified")


#: CRC-32 of the decimal doc_id in SQL: each byte is folded in and followed by seven shifts without input.
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda ch: [ascii(ch)::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT]))),
  lambda c, e: xor(xor(c, e) >> 1, CASE WHEN xor(c, e) & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)), 4294967295::UBIGINT)"""


def _leaf_sql(text: str) -> str:
    part = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_UP_SQL = "list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], '')))"

MANIFEST_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, {_leaf_sql('text')} AS leaf,
    CASE WHEN {_CRC} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql('text')} END AS seen FROM documents),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t AS (
  SELECT source, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY source
  UNION ALL SELECT source, level + 1, {_UP_SQL} FROM t WHERE len(nodes) > 1),
s AS MATERIALIZED (
  SELECT source, level AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM t WHERE len(nodes) = 1),
g AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM s
  UNION ALL SELECT level + 1, {_UP_SQL} FROM g WHERE len(nodes) > 1),
steps AS MATERIALIZED (
  SELECT source, height, level, nodes, true AS inside, 0 AS place FROM t JOIN s USING (source) WHERE t.source IS NOT NULL AND len(nodes) > 1
  UNION ALL SELECT s.source, height, t.level, nodes, true, 0 FROM t, s WHERE t.source IS NULL AND s.source IS NULL AND len(nodes) > 1
  UNION ALL SELECT s.source, height, height + g.level, nodes, false, place FROM s, g WHERE len(nodes) > 1),
q AS MATERIALIZED (
  SELECT p.doc_id, p.leaf, p.pos, steps.level, nodes,
    CAST(CASE WHEN inside THEN p.pos // CAST(3 ** level AS BIGINT) ELSE place // CAST(3 ** (level - height) AS BIGINT) END AS BIGINT) AS i
  FROM p JOIN steps ON p.source IS NOT DISTINCT FROM steps.source),
w AS MATERIALIZED (
  SELECT doc_id, leaf, level, array_to_string(nodes[i - i % 3 + 1:i], '') AS l, array_to_string(nodes[i + 2:i - i % 3 + 3], '') AS r FROM q),
proof AS MATERIALIZED (SELECT doc_id, leaf, list(struct_pack(l := l, r := r) ORDER BY level) AS steps FROM w GROUP BY doc_id, leaf)
SELECT p.doc_id, p.leaf, s.subroot, top.root,
  sha256(coalesce(array_to_string(list_transform(proof.steps, lambda x: x.l || x.r), ''), '')) AS proof_sha256,
  list_reduce(list_concat([p.seen], list_transform(coalesce(proof.steps, []), lambda x: x.l || '|' || x.r)),
    lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root,
  folded_root = top.root AS verified
FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source
CROSS JOIN (SELECT nodes[1] AS root FROM g WHERE len(nodes) = 1) top
LEFT JOIN proof ON proof.doc_id IS NOT DISTINCT FROM p.doc_id AND proof.leaf = p.leaf
"""
