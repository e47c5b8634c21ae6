"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are trained on a bounded sample of labelled documents and flattened
into arrays; scoring walks all trees of a batch of documents at once.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, remembers, slices

#: At most so many labelled documents are used to fit; those with the smallest hash of their id.
MAX_TRAINING_ROWS = 20_000

FEATURES = (
    "log_bytes", "log_words", "word_length", "word_length_sd", "upper", "digit", "punctuation", "space", "non_ascii",
    "newline", "log_lines", "line_words", "distinct_words", "distinct_triples", "repeated_lines", "top_word", "entropy",
    "compressed", "same_neighbours", "word_ends_odd", "symbol_words", "bar", "exclamation", "capital_words",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_HIGH = np.arange(256) >= 128
_PUNCTUATION = ~(_DIGIT | _ALPHA | _SPACE | _HIGH)
_PLAIN_END = np.zeros(256, bool)
_PLAIN_END[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 44, 46, 58, 59, 34, 39, 41]] = True


def statistics(text: str) -> list[float]:
    """The statistics of one whole text, in the order of ``FEATURES``; an empty text has zeros."""
    data = text.encode("utf-8", "replace")
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    k = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = [line for line in data.split(b"\n") if line]
    share = counts[counts > 0] / n
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    triples = len(set(zip(words, words[1:], words[2:]))) if len(words) > 2 else 0
    ends = np.frombuffer(bytes(w[-1] for w in words), np.uint8) if words else np.zeros(0, np.uint8)
    return [
        math.log(n), math.log(k), float(lengths.mean()), float(lengths.std()), counts[_UPPER].sum() / n,
        counts[_DIGIT].sum() / n, counts[_PUNCTUATION].sum() / n, counts[_SPACE].sum() / n, counts[_HIGH].sum() / n,
        counts[10] / n, math.log(max(1, len(lines))), k / max(1, len(lines)), len(seen) / k,
        triples / max(1, len(words) - 2), 1 - len(set(lines)) / max(1, len(lines)), max(seen.values(), default=0) / k,
        float(-(share * np.log2(share)).sum()), len(zlib.compress(data, 1)) / n,
        sum(map(bytes.__eq__, words, words[1:])) / k, float((~_PLAIN_END[ends]).sum()) / k,
        sum(1 for w in words if len(w) > 1 and not w[-1:].isalnum() and w[-1] == w[-2] and w[-1] < 128) / k,
        counts[124] / k, counts[33] / k, sum(1 for w in words if w.isupper() and len(w) > 1) / k,
    ]


def matrix(texts: list[str]) -> np.ndarray:
    """Statistics of many texts, one row each."""
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass(frozen=True)
class Trees:
    """Complete binary trees as arrays: node ``i`` has the children ``2 i + 1`` (at most the limit) and ``2 i + 2``."""

    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray  # trees x inner nodes
    leaf: np.ndarray  # trees x leaves
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves of all trees (log-odds) per row of ``x``."""
        inner = self.feature.shape[1]
        if not self.feature.size:
            return np.full(len(x), self.start)
        tree = np.arange(self.feature.shape[0])[None, :]
        row = np.arange(len(x))[:, None]
        node = np.zeros((len(x), self.feature.shape[0]), np.int64)
        for _ in range(int(math.log2(inner + 1))):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.limit[tree, node])
        return self.start + self.leaf[tree, node - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
    least: int = 10, ridge: float = 1.0,
) -> Trees:
    """Boosted trees for the logistic loss, from histograms of binned features.

    Without rows, or with one class only, the result has no trees and scores by the smoothed share of label 1.
    """
    inner = 2**depth - 1
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    none = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    if not len(y) or y.min() == y.max():
        return none
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    code = np.stack([np.searchsorted(cuts[j], x[:, j]) for j in range(width)], axis=1)
    offset = np.arange(width) * bins
    flat = (code + offset).astype(np.int64)
    raw = np.full(n, start)
    features, limits, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, hessian = y - p, p * (1 - p)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first = 2**level - 1
            for at in range(first, 2 * first + 1):
                mine = np.flatnonzero(node == at)
                if len(mine) < 2 * least:
                    continue
                keys = flat[mine].ravel()
                size = width * bins
                g = np.bincount(keys, np.repeat(gradient[mine], width), size).reshape(width, bins).cumsum(axis=1)
                h = np.bincount(keys, np.repeat(hessian[mine], width), size).reshape(width, bins).cumsum(axis=1)
                c = np.bincount(keys, minlength=size).reshape(width, bins).cumsum(axis=1)
                gr, hr, cr = g[:, -1:] - g, h[:, -1:] - h, c[:, -1:] - c
                gain = g**2 / (h + ridge) + gr**2 / (hr + ridge) - (g[:, -1:] ** 2) / (h[:, -1:] + ridge)
                gain[(c < least) | (cr < least)] = -1
                best = int(gain.argmax())
                j, b = divmod(best, bins)
                if gain[j, b] > 1e-9 and b < len(cuts[j]):
                    feature[at], limit[at] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > limit[node])
        slot = node - inner
        value = rate * np.bincount(slot, gradient, inner + 1) / (np.bincount(slot, hessian, inner + 1) + ridge)
        raw += value[slot]
        features.append(feature)
        limits.append(limit)
        leaves.append(value)
    return Trees(np.stack(features), np.stack(limits), np.stack(leaves), start)


def train_quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    max_rows: int = MAX_TRAINING_ROWS, **options,
) -> Trees:
    """Fit on labelled documents.

    ``labels`` holds the rows to learn from. Null ids and labels are left out; of several labels of one id the smallest
    counts, and of repeated documents one. Null texts count as empty. Of more than ``max_rows`` labelled ids those with
    the smallest hash are taken, so the sample that is broadcast and the statistics that reach the driver are bounded.
    """
    sample = (
        labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label"))
        .where("_id IS NOT NULL AND _label IS NOT NULL")
        .groupBy("_id").agg(F.min("_label").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    )
    picked = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    kind = picked.schema["_id"].dataType.simpleString()

    def measure(batches: Batches) -> Batches:
        remembers("quality")
        for batch in slices(batches):
            x = matrix(batch.column("_text").to_pylist())
            values = pa.array(list(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), values], ["_id", "_label", "x"])

    rows = (
        picked.join(F.broadcast(sample), "_id")
        .select("_id", "_label", "_text")
        .mapInArrow(measure, f"_id {kind}, _label int, x array<double>")
        .groupBy("_id").agg(F.min(F.struct("x", "_label")).alias("r"))
        .select("_id", "r.x", "r._label").collect()
    )
    rows.sort(key=lambda r: r[0])
    x = np.array([r[1] for r in rows], np.float64).reshape(len(rows), len(FEATURES))
    return fit_trees(x, np.array([r[2] for r in rows], np.float64), **options)


def score_quality(docs: DataFrame, trees: Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` per row of ``docs``, repeated rows and null ids included.

    The score is a function of the text alone; a null text counts as empty.
    """
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    kind = picked.schema["doc_id"].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        remembers("quality")
        for batch in slices(batches):
            score = trees.score(matrix(batch.column("_text").to_pylist()))
            predicted = (score >= 0.5).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(predicted)], ["doc_id", "score", "predicted"])

    return picked.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, trees: Trees, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``."""
    names = docs.columns
    at = [i for i, name in enumerate(names) if name.lower() == text.lower()][0]

    def run(batches: Batches) -> Batches:
        remembers("quality")
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(trees.score(matrix(texts)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
