"""Language-model scores by a weighted backoff automaton.

The model is an n-gram model over words with Dirichlet smoothing: seen n-grams
are arcs, their histories states, and a failure arc leads from each state to the
next shorter history. Documents are dealt into blocks of bounded size. Each
block sends its distinct n-grams once with their training counts; buckets of
n-gram hashes add the counts of all blocks and send them back in the order of
the block. So a block has the part of the automaton that its own texts can
reach, and walks it once, left to right, all its documents side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexward.sources.scratch import materialize

from .common import remembers

#: UTF-8 bytes of text per block (more only where one document is longer); bounds the memory of a task.
BLOCK_BYTES = 8 << 20
#: Blocks whose n-grams, as many as fall into one bucket of hashes on average, meet in one task. More make fewer and larger messages
#: between blocks and buckets, which are as many as blocks times buckets; some 8 MB of hashes come from each.
BLOCKS_A_BUCKET = 4
#: Word hashes that a Python process remembers; bounds memory only.
REMEMBERED = 300_000

_END, _BEGIN = (np.uint64(xxhash.xxh64_intdigest(mark)) for mark in (b" end ", b" begin "))  # no words: they hold spaces
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    """Hashes of words; a word that is not remembered is hashed when it is looked up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()
_compressor, _decompressor = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()  # a new one costs more than a small message


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case; spaces and the control characters 9 to 13 part them."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``np.unique`` with index and inverse, but only the distinct values are sorted."""
    coded = pa.array(values).dictionary_encode()
    codes, found = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    first = np.empty(len(found), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    by = np.argsort(found)
    place = np.empty(len(found), np.int64)
    place[by] = np.arange(len(found))
    return found[by], first[by], place[codes]


class Block:
    """N-grams of the documents of a block. ``keys[k]``: sorted distinct hashes of the k-grams."""

    def __init__(self, texts: list[str | None], order: int):
        remembers("backoff", _hashes.clear)
        if len(_hashes) > REMEMBERED:
            _hashes.clear()
        flat: list[int] = []
        lengths = np.zeros(len(texts), np.int64)
        for d, text in enumerate(texts):
            words = words_of(text)
            flat.append(int(_BEGIN))
            flat.extend(map(_hashes.__getitem__, words))
            flat.append(int(_END))
            lengths[d] = len(words) + 1
        self.lengths = lengths
        self.first = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]  # position of each begin mark
        token = np.array(flat, np.uint64)
        self.place = np.arange(len(token)) - np.repeat(self.first, lengths + 1)  # 0: begin mark
        self.doc = np.repeat(np.arange(len(texts)), lengths + 1)
        self.keys, self.index, self.at, gram = {}, {}, {}, _mixed(token)
        for k in range(1, order + 1):
            if k > 1:
                gram = np.concatenate([np.zeros(1, np.uint64), _mixed(gram[:-1] * _A + token[1:])]) if len(gram) else gram
            valid = self.place >= max(1, k - 1)  # the begin mark stands in histories, but is no token
            keys, where, inverse = _distinct(gram[valid])
            index = np.full(len(token), -1, np.int64)
            index[valid] = inverse
            self.keys[k], self.index[k], self.at[k] = keys, index, np.flatnonzero(valid)[where]

    def train_counts(self, k: int, train: np.ndarray) -> np.ndarray:
        """Occurrences of each k-gram in the training documents."""
        index = self.index[k]
        return np.bincount(index[(index >= 0) & train[self.doc]], minlength=len(self.keys[k])).astype(np.uint32)


def _pack_keys(keys: np.ndarray) -> bytes:
    steps = np.diff(keys, prepend=np.zeros(1, np.uint64))
    return _compressor.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_decompressor.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    return _compressor.compress(np.ascontiguousarray(counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_decompressor.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel().astype(np.int64)


def _bucket_bounds(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted hashes fall into, and where each begins (with the end)."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    names, starts = np.unique(bucket, return_index=True)
    return names.astype(np.int64), np.append(starts, len(keys))


class Automaton:
    """The part of the model that the documents of a block can reach.

    State 0 is the empty history. Arcs are kept in the order of (state, token); ``fail`` and ``fail_weight`` lead to the
    next shorter history.
    """

    def __init__(self, block: Block, counts: dict[int, np.ndarray], tokens: int, types: int, order: int, prior: float):
        size = len(block.place)
        end = np.searchsorted(block.keys[1], _mixed(np.array([_END])))[0] if size else 0
        begun = int(counts[1][end]) if size else 0
        self.unknown = np.log10((types + 1) / (tokens + types + 1))
        self.width = max(1, len(block.keys[1]))
        state: dict[int, np.ndarray] = {0: np.zeros(size, np.int64)}
        fail, fail_weight, n = [np.zeros(1, np.int64)], [np.zeros(1)], 1
        for k in range(1, order):
            ids = np.full(len(block.keys[k]), -1, np.int64)
            known = np.flatnonzero(counts[k] > 0)
            ids[known] = n + np.arange(len(known))
            n += len(known)
            here = np.full(size, -1, np.int64)
            valid = block.index[k] >= 0
            here[valid] = ids[block.index[k][valid]]
            fail.append(state[k - 1][block.at[k][known]])
            fail_weight.append(np.log10(prior / (counts[k][known] + prior)))
            if k == 1 and begun:
                here[block.place == 0] = n
                n += 1
                fail.append(np.zeros(1, np.int64))
                fail_weight.append(np.array([np.log10(prior / (begun + prior))]))
            state[k] = here
        self.start = state[1][block.first] if order > 1 and begun else np.zeros(len(block.first), np.int64)
        self.fail, self.fail_weight = np.concatenate(fail), np.concatenate(fail_weight)
        arcs, weights, targets, lower = [], [], [], None
        for k in range(1, order + 1):
            known = np.flatnonzero(counts[k] > 0)
            at = block.at[k][known]
            c = counts[k][known].astype(float)
            if k == 1:
                p = c / (tokens + types + 1)
            else:
                before = block.index[k - 1][at - 1]
                history = np.where(before >= 0, counts[k - 1][before], begun)
                p = (c + prior * lower[block.index[k - 1][at]]) / (history + prior)
            full = np.zeros(len(block.keys[k]))
            full[known] = p
            lower = full
            arcs.append(state[k - 1][at - 1 if k > 1 else at] * self.width + block.index[1][at])
            weights.append(np.log10(p))
            targets.append(state[min(k, order - 1)][at])
        arc = np.concatenate(arcs)
        by = np.argsort(arc, kind="stable")
        self.arc, self.weight, self.target = arc[by], np.concatenate(weights)[by], np.concatenate(targets)[by]

    def scores(self, block: Block) -> np.ndarray:
        """Log10 probability of each document: one walk, in step for all documents."""
        by = np.argsort(-block.lengths, kind="stable")
        state, total = self.start[by].copy(), np.zeros(len(by))
        first, lengths, token = block.first[by], block.lengths[by], block.index[1]
        active = len(by)
        for step in range(1, (int(lengths[0]) if active else 0) + 1):
            while lengths[active - 1] < step:
                active -= 1
            todo = np.arange(active)
            tokens = token[first[:active] + step]
            while len(todo):
                wanted = state[todo] * self.width + tokens[todo]
                found = np.searchsorted(self.arc, wanted)
                found[found == len(self.arc)] = 0
                hit = self.arc[found] == wanted if len(self.arc) else np.zeros(len(todo), bool)
                done = todo[hit]
                total[done] += self.weight[found[hit]]
                state[done] = self.target[found[hit]]
                todo = todo[~hit]
                lost = todo[state[todo] == 0]
                total[lost] += self.unknown
                todo = todo[state[todo] != 0]
                total[todo] += self.fail_weight[state[todo]]
                state[todo] = self.fail[state[todo]]
        out = np.empty(len(by))
        out[by] = total
        return out


def lm_scores(
    docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", order: int = 2, prior: float = 30.0,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, in_training, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``.

    The counts come from all rows for which ``train`` (a column over ``docs``) holds; null counts as false. Tokens are the
    words of whole texts and one end each, also for null and empty texts. The base is an add-one unigram model; ``score``
    is the log10 probability of the tokens under the smoothed n-grams, with one class for all unknown words. Repeated rows
    count and stay. Without training rows everything is unknown, with probability 1.
    """
    placed = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train")
    )
    size = placed.agg(F.sum(F.octet_length("text").cast("bigint") + 64)).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    buckets = blocks // BLOCKS_A_BUCKET + 1
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    id_type = dict(placed.dtypes)["doc_id"]

    def count(table: pa.Table) -> pa.Table:
        block = Block(table.column("text").to_pylist(), order)
        train_docs = table.column("train").to_numpy(zero_copy_only=False).astype(bool)
        name = table.column("block")[0].as_py()
        rows = []
        for k in range(1, order + 1):
            counts = block.train_counts(k, train_docs)
            names, starts = _bucket_bounds(block.keys[k], buckets)
            for b, i, j in zip(names, starts, starts[1:]):
                rows.append((k, int(b), name, _pack_keys(block.keys[k][i:j]), _pack_counts(counts[i:j])))
        return pa.table([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(),) * 3 + (pa.binary(),) * 2)], ["n", "bucket", "block", "keys", "counts"])

    def add_up(table: pa.Table) -> pa.Table:
        keys = [_unpack_keys(v) for v in table.column("keys").to_pylist()]
        counts = np.concatenate([_unpack_counts(v) for v in table.column("counts").to_pylist()])
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, inverse, counts)
        ends = np.cumsum([len(k) for k in keys])
        answers = [_pack_counts(total[inverse[e - len(k) : e]]) for k, e in zip(keys, ends)]
        first = [1] + [0] * (len(keys) - 1)  # the sums of a bucket stand in one of its rows
        return pa.table(
            [table.column("block"), table.column("n"), table.column("bucket"), pa.array(answers, pa.binary()),
             pa.array([int(total.sum()) * f for f in first], pa.int64()), pa.array([int((total > 0).sum()) * f for f in first], pa.int64())],
            ["block", "n", "bucket", "counts", "total", "types"],
        )

    grams = placed.groupBy("block").applyInArrow(count, "n bigint, bucket bigint, block bigint, keys binary, counts binary")
    answers = materialize(
        grams.groupBy("n", "bucket").applyInArrow(add_up, "block bigint, n bigint, bucket bigint, counts binary, total bigint, types bigint"), "lm-counts"
    )
    sums = answers.where("n = 1").agg(F.sum("total"), F.sum("types")).first()
    tokens, types = sums[0] or 0, sums[1] or 0

    def score(texts: pa.Table, answer: pa.Table) -> pa.Table:
        block = Block(texts.column("text").to_pylist(), order)
        parts = sorted(zip(answer.column("n").to_pylist(), answer.column("bucket").to_pylist(), answer.column("counts").to_pylist()), key=lambda r: r[:2])
        counts = {k: np.concatenate([_unpack_counts(c) for n, _, c in parts if n == k] or [np.zeros(0, np.int64)]) for k in range(1, order + 1)}
        total = Automaton(block, counts, tokens, types, order, prior).scores(block)
        of_token = block.index[1] >= 0
        c = counts[1][block.index[1][of_token]]
        doc, n = block.doc[of_token], len(block.lengths)
        base = np.bincount(doc, np.log10((c + 1) / (tokens + types + 1)), n)
        known = np.bincount(doc, c > 0, n).astype(np.int64)
        return pa.table(
            [texts.column("doc_id"), texts.column("train"), pa.array(block.lengths), pa.array(known), pa.array(np.full(n, tokens, np.int64)), pa.array(base), pa.array(total)],
            ["doc_id", "in_training", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    schema = f"doc_id {id_type}, in_training boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return placed.groupBy("block").cogroup(answers.select("block", "n", "bucket", "counts").groupBy("block")).applyInArrow(score, schema)
