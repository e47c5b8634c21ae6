"""Hard negatives by a vertical scan over columns of vectors (BOND).

Vectors are written in blocks, one column per dimension. Per anchor, the
dimensions of a block are read in descending order of the anchor's magnitude;
what the dimensions still unread can add, at least and at most, follows from the
least and largest value of each column. Rows that can no longer enter the result
leave the candidate bitmap, and rows that stay to the end have their exact score.

Anchors are a part of the rows and grow with them. They are worked in rounds of
bounded size: each round broadcasts its anchors and scans all blocks once.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from indexward.sources.scratch import materialize

from .common import Batches

#: Rows of a block, anchors that are broadcast in one round, dimensions that are read before bounds are compared again.
BLOCK_ROWS, ANCHORS_AT_ONCE, STEP = 1024, 4096, 8

#: Stands for a null id, which comes after all others.
_NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Window10:
    """Which negatives belong to a positive: ``low * p <= of * score <= high * p`` for the positive's score p."""

    low: int = 30
    high: int = 90
    of: int = 100

    def ends(self, positive: int) -> tuple[int, int]:
        """Least and largest score inside; empty if the first is above the second."""
        return -(-self.low * positive // self.of), self.high * positive // self.of


def exact_vector(vector: str, scale: int = 256) -> Column:
    """The components as ``floor(scale * x)``, or null if the vector or a component is null or not finite."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("bigint")))


def _pruned(values: np.ndarray, anchor: np.ndarray, order: np.ndarray, alive: np.ndarray, outside: Callable[[np.ndarray, np.ndarray], np.ndarray],
            least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that stay and their scores. ``outside`` tells from lowest and highest possible scores which rows cannot count."""
    a = anchor[order]
    low = np.minimum(a * least[order], a * most[order])
    high = np.maximum(a * least[order], a * most[order])
    low_rest, high_rest = low[::-1].cumsum()[::-1], high[::-1].cumsum()[::-1]
    rows = np.flatnonzero(alive)
    score = np.zeros(len(rows), values.dtype)
    for at in range(0, len(order), STEP):
        if not len(rows):
            break
        gone = outside(score + low_rest[at], score + high_rest[at])
        if gone.any():
            rows, score = rows[~gone], score[~gone]
        dims = order[at : at + STEP]
        # Few candidates are gathered by row; for many, whole columns are read.
        part = values[dims][:, rows] if 2 * len(rows) < values.shape[1] else None
        score = score + (anchor[dims] @ part if part is not None else (anchor[dims] @ values[dims])[rows])
    gone = outside(score, score)
    return rows[~gone], score[~gone]


class _Block:
    """One block: ids, keys, labels, and the vectors by dimension."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.keys = np.frombuffer(row["keys"], np.int64)
        self.labels = np.frombuffer(row["labels"], np.int64)
        self.values = np.frombuffer(row["columns"], np.int64).reshape(-1, len(self.ids))

    def for_anchors(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns and anchor vectors of one width, in floating point where that is exact."""
        width = max(len(self.values), vectors.shape[1])
        values = np.pad(self.values, ((0, width - len(self.values)), (0, 0)))
        anchors = np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
        largest = int(np.abs(values).max(initial=0)) * int(np.abs(anchors).max(initial=0)) * max(1, width)
        if largest >= 1 << 62:
            raise ValueError("scores do not fit in 64 bits")
        kind = np.float64 if largest < 1 << 53 else np.int64
        return values.astype(kind), anchors.astype(kind)


def _blocks(vectors: DataFrame, vec_id: str, vector: str, label: Column, rows: int) -> DataFrame:
    """``ids, keys, labels, columns`` per block of at most about ``rows`` rows; a key is unique over all rows."""
    picked = vectors.select(F.col(vec_id).cast("bigint").alias("id"), label.cast("bigint").alias("label"), exact_vector(vector).alias("v"))
    kept = picked.where("label IS NOT NULL AND v IS NOT NULL")

    def pack(batches: Batches) -> Batches:
        def out(ids: list, labels: list, keys: list, vectors_: list) -> pa.RecordBatch:
            width = max(map(len, vectors_))
            full = np.zeros((len(ids), width), np.int64)
            for i, v in enumerate(vectors_):
                full[i, : len(v)] = v
            data = [np.array([_NO_ID if i is None else i for i in ids], np.int64), np.array(keys, np.int64), np.array(labels, np.int64), np.ascontiguousarray(full.T)]
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in data], ["ids", "keys", "labels", "columns"])

        held: tuple[list, list, list, list] = ([], [], [], [])
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "key", "v"))):
                for column, value in zip(held, row):
                    column.append(value)
                if len(held[0]) >= rows:
                    yield out(*held)
                    held = ([], [], [], [])
        if held[0]:
            yield out(*held)

    keyed = materialize(kept.withColumn("key", F.monotonically_increasing_id()), "vectors")
    # Rows are dealt by key, so that equal vectors and labels are spread; the number of parts follows the number of rows.
    parts = max(1, -(-keyed.count() // rows))
    dealt = keyed.repartition(min(parts, 10_000), F.xxhash64("key")).sortWithinPartitions("key")
    return materialize(dealt.mapInArrow(pack, "ids binary, keys binary, labels binary, columns binary"), "vector-blocks")


def _top(kept: dict, group, item: tuple, count: int) -> None:
    """Keep the ``count`` largest items of a group."""
    heap = kept.setdefault(group, [])
    if len(heap) < count:
        heapq.heappush(heap, item)
    elif item > heap[0]:
        heapq.heapreplace(heap, item)


def _search(blocks: DataFrame, anchors: list, best: int, window: Window10 | None) -> DataFrame:
    """Best rows of each anchor in each part of the blocks.

    Without ``window``: ``anchor`` (key), ``id, score``, the ``best`` rows of the same label. With it, ``anchor, place, id,
    score``: per place in the anchor's list of positive scores the ``best`` rows of other labels inside the window.
    """
    width = max((len(a["v"]) for a in anchors), default=0)
    vectors = np.zeros((len(anchors), width), np.int64)
    for i, a in enumerate(anchors):
        vectors[i, : len(a["v"])] = a["v"]
    told = blocks.sparkSession.sparkContext.broadcast((vectors, [(a["key"], a["label"], a["positives"]) for a in anchors]))

    def run(batches: Batches) -> Batches:
        vectors, about = told.value
        kept: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row)
                values, mine = block.for_anchors(vectors)
                least, most = values.min(axis=1), values.max(axis=1)
                for i, (key, label, positives) in enumerate(about):
                    order = np.argsort(-np.abs(mine[i]), kind="stable")
                    if window is None:
                        heap = kept.get((key, 0), [])
                        floor = heap[0][0] if len(heap) == best else -np.inf
                        alive = (block.labels == label) & (block.keys != key)
                        rows, scores = _pruned(values, mine[i], order, alive, lambda lo, hi, f=floor: hi < f, least, most)
                        ends = [(-np.inf, np.inf)]
                    else:
                        ends = [window.ends(p) for p in positives]
                        floors = []
                        for place, (low, _) in enumerate(ends):
                            heap = kept.get((key, place), [])
                            floors.append(max(low, heap[0][0]) if len(heap) == best else low)

                        def outside(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
                            inside = np.zeros(len(lo), bool)
                            for floor, (_, top) in zip(floors, ends):
                                inside |= (hi >= floor) & (lo <= top)
                            return ~inside

                        rows, scores = _pruned(values, mine[i], order, block.labels != label, outside, least, most)
                    for place, (low, high) in enumerate(ends):
                        fit = np.flatnonzero((scores >= low) & (scores <= high))
                        if len(fit) > best:  # the largest, ties of the last among them included
                            fit = fit[scores[fit] >= np.partition(scores[fit], -best)[-best]]
                        for r, s in zip(rows[fit].tolist(), scores[fit].tolist()):
                            _top(kept, (key, place), (int(s), -int(block.ids[r])), best)
        out = [(key, place, None if -i == _NO_ID else -i, s) for (key, place), heap in kept.items() for s, i in heap]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        columns = [pa.array(v, t) for v, t in zip(zip(*out) if out else ((),) * 4, types)]
        yield pa.RecordBatch.from_arrays(columns, ["anchor", "place", "id", "score"])

    # Blocks are small files and long work: dealt to all shuffle partitions, not by bytes.
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = blocks.repartition(parts, F.xxhash64("keys")).mapInArrow(run, "anchor bigint, place int, id bigint, score bigint")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def _anchor_rounds(blocks: DataFrame, is_anchor: Callable[[np.ndarray], np.ndarray], at_once: int) -> Iterator[list]:
    """The anchors (``key, id, label, v``) in lists of about ``at_once``."""

    def pick(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row)
                mine = np.flatnonzero(is_anchor(block.ids) & (block.ids != _NO_ID))
                columns = [pa.array(block.keys[mine]), pa.array(block.ids[mine]), pa.array(block.labels[mine]), pa.array(list(block.values[:, mine].T), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "id", "label", "v"])

    anchors = materialize(blocks.mapInArrow(pick, "key bigint, id bigint, label bigint, v array<bigint>"), "anchors")
    rounds = max(1, -(-anchors.count() // at_once))
    for k in range(rounds):
        yield anchors.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k).collect()


def hard_negatives(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label", every: int = 100, positives: int = 5,
    negatives: int = 10, window: Window10 | None = None, block_rows: int = BLOCK_ROWS, anchors_at_once: int = ANCHORS_AT_ONCE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``; their positives the first ``positives`` other rows of the same
    label, and per positive the first ``negatives`` rows of other labels with a score inside the window, by descending score
    and then ascending id. Scores are exact inner products of ``floor(256 * x)``. Whole results for every anchor: bounds only
    spare work.

    Rows with a null label, a null vector or a component that is null or not finite take no part. A null id is no anchor and
    comes after all others on ties. Repeated ids are rows of their own: each is an anchor, and a positive of the others.
    Shorter vectors count as filled up with zeros. Scores that might not fit in 64 bits raise an error. An empty table, or
    one without anchors, gives no rows; other columns do not matter.
    """
    window = window or Window10()
    spark = vectors.sparkSession
    blocks = _blocks(vectors, vec_id, vector, F.col(label) if isinstance(label, str) else label, block_rows)
    out = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    for rows in _anchor_rounds(blocks, lambda ids: ids % every == 0, anchors_at_once):
        anchors = [r.asDict() | {"positives": []} for r in rows]
        near: dict[int, list] = {}
        for r in _search(blocks, anchors, positives, None).collect():
            near.setdefault(r["anchor"], []).append((r["rank"], r["id"], r["score"]))
        pairs = []
        for a in anchors:
            mine = sorted(near.get(a["key"], []))
            a["positives"] = [s for _, _, s in mine]
            pairs += [(a["key"], place, a["id"], i, s) for place, (_, i, s) in enumerate(mine)]
        if not pairs:
            continue
        told = spark.createDataFrame(pairs, "anchor bigint, place int, anchor_id bigint, positive_id bigint, positive_score bigint")
        found = _search(blocks, [a for a in anchors if a["positives"]], negatives, window).join(F.broadcast(told), ["anchor", "place"])
        found = found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = out.unionByName(materialize(found, "hard-negatives"))
    return out


NEGATIVES_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS MATERIALIZED (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
