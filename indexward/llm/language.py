"""Language identification by interpolated Kneser-Ney models of characters.

Each language has its own model. Counts of the longest n-grams hold all that the
lower orders need, so one distributed aggregate gives the models. A model is kept
as sorted arrays of hashes with log-probabilities and back-off weights; a text
goes to the language with the least cross-entropy per character. A part of the
training texts calibrates how sure that is and when no language fits.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from indexward.sources.scratch import scratch_table

from .common import Batches, slices

#: At most so many labelled texts are used to fit, evenly over the languages; those with the smallest hash of the id.
MAX_TRAINING_ROWS = 12_000
#: Of these, one in so many only calibrates.
CALIBRATION = 5
#: Calibration texts are also judged by pieces of so many characters.
PIECES = (24, 96, 384)

UNKNOWN = "und"
_SPACE = 32
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_fold: np.ndarray | None = None


def _folding() -> np.ndarray:
    """For each code point: its lower case if it is a letter, itself if it is a mark, else a space."""
    global _fold
    if _fold is None:
        _fold = np.full(0x110000, _SPACE, np.uint32)
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                low = c.lower()
                _fold[code] = ord(low) if len(low) == 1 else code
            elif unicodedata.category(c)[0] == "M":
                _fold[code] = code
    return _fold


def characters(text: str, order: int) -> np.ndarray:
    """Letters in lower case, anything else as single spaces, after ``order - 1`` spaces; empty if there is no letter."""
    if not any(map(str.isalpha, text)):
        return np.zeros(0, np.uint32)
    folded = _folding()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = folded == _SPACE
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[0] = not space[0]
    return np.concatenate([np.full(order - 1, _SPACE, np.uint32), folded[keep]])


def grams(codes: np.ndarray, order: int) -> np.ndarray:
    """All n-grams of a sequence of code points, one row each."""
    return np.lib.stride_tricks.sliding_window_view(codes, order) if len(codes) >= order else np.zeros((0, order), np.uint32)


def pieces(texts: list[np.ndarray], order: int, size: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All n-grams of many texts, at most ``size`` at once, with the number of their text."""
    owners, rows, held = [], [], 0
    for i, text in enumerate(texts):
        own = grams(text, order)
        while len(own):
            part, own = own[: size - held], own[size - held :]
            owners.append(np.full(len(part), i))
            rows.append(part)
            held += len(part)
            if held == size:
                yield np.concatenate(owners), np.concatenate(rows)
                owners, rows, held = [], [], 0
    if held:
        yield np.concatenate(owners), np.concatenate(rows)


def hashes(rows: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams; grams that share their last characters need not share anything."""
    order = rows.shape[1]
    out = np.zeros(len(rows), np.uint64)
    for k in range(order):
        out += (rows[:, k].astype(np.uint64) + np.uint64(1)) * _MULTIPLIERS[k]
        out ^= out >> np.uint64(29)
    return out


@dataclass(frozen=True)
class Model:
    """One language. Per order: sorted hashes and log-probabilities of n-grams, sorted hashes and log-weights of contexts."""

    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    unknown: float

    def log_probability(self, rows: np.ndarray) -> np.ndarray:
        """Natural log-probability of the last character of each n-gram after the others."""
        total = np.zeros(len(rows))
        left = np.arange(len(rows))
        order = len(self.keys)
        for k in range(order, 0, -1):
            part = rows[left, order - k :]
            at, there = _find(self.keys[k - 1], hashes(part))
            total[left[there]] += self.logs[k - 1][at[there]]
            left, part = left[~there], part[~there]
            if k > 1:
                at, there = _find(self.contexts[k - 1], hashes(part[:, :-1]))
                total[left[there]] += self.weights[k - 1][at[there]]
        total[left] += self.unknown
        return total


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted hash in sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _grouped(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in order of their hashes, these hashes, the sum of their counts and their number."""
    keys, first, group = np.unique(hashes(rows), return_index=True, return_inverse=True)
    group = group.ravel()
    return rows[first], keys, np.bincount(group, counts, len(keys)), np.bincount(group, minlength=len(keys))


def fit_model(rows: np.ndarray, counts: np.ndarray) -> Model:
    """Interpolated Kneser-Ney from the distinct n-grams of the highest order and their counts.

    Lower orders count the distinct characters before an n-gram. The discount of an order is ``n1 / (n1 + 2 n2)``. Below the
    single characters lies an even share for each known character and one for all unknown.
    """
    order = rows.shape[1]
    now, keys, weight, _ = _grouped(rows, counts.astype(np.float64))
    by_order = [(now, keys, weight)]
    for _ in range(order - 1):
        now, keys, _, distinct = _grouped(now[:, 1:], weight)
        weight = distinct.astype(np.float64)
        by_order.insert(0, (now, keys, weight))
    all_keys, logs, contexts, weights = [], [], [], []
    lower_keys, lower_p = np.zeros(1, np.uint64), np.array([1.0 / (len(by_order[0][0]) + 1)])
    unknown = 0.0
    for k, (now, keys, c) in enumerate(by_order, 1):
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        discount = n1 / (n1 + 2 * n2) if n1 else 0.1
        _, context, total, followers = _grouped(now[:, :-1], c)
        back = discount * followers / total
        at, low = _find(context, hashes(now[:, :-1]))[0], _find(lower_keys, hashes(now[:, 1:]))[0]
        p = (c - discount) / total[at] + back[at] * lower_p[low]
        if k == 1:
            unknown = float(np.log(back[0] * lower_p[0]))
        all_keys.append(keys)
        logs.append(np.log(p))
        contexts.append(context)
        weights.append(np.log(back))
        lower_keys, lower_p = keys, p
    return Model(all_keys, logs, contexts, weights, unknown)


@dataclass(frozen=True)
class Languages:
    """Models by language, and what the calibration texts gave.

    ``sharpness`` turns differences of cross-entropy into odds; ``center`` and ``spread`` are mean and deviation of the
    log-probability per character of a language's own texts; ``odd`` are the sorted deviations of calibration texts.
    """

    order: int
    names: list[str]
    models: list[Model]
    sharpness: float = 1.0
    center: np.ndarray | None = None
    spread: np.ndarray | None = None
    odd: np.ndarray | None = None

    def totals(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability per text and language, and characters per text."""
        sizes = np.array([max(0, len(t) - self.order + 1) for t in texts], np.int64)
        out = np.zeros((len(texts), len(self.names)))
        for owner, rows in pieces(texts, self.order):
            _, first, place = np.unique(hashes(rows), return_index=True, return_inverse=True)
            distinct, place = rows[first], place.ravel()
            for k, model in enumerate(self.models):
                out[:, k] += np.bincount(owner, model.log_probability(distinct)[place], len(texts))
        return out, sizes

    def judge(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language (-1: none), its probability, cross-entropy per character, and share of own texts that are as odd."""
        totals, sizes = self.totals(texts)
        n = np.maximum(sizes, 1)
        if not self.names:
            return np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
        entropy = -totals / n[:, None]
        best = entropy.argmin(axis=1)
        odds = -self.sharpness * np.sqrt(n)[:, None] * (entropy - entropy.min(axis=1, keepdims=True))
        score = 1 / np.exp(np.maximum(odds, -700)).sum(axis=1)
        at = np.arange(len(texts))
        usual = np.ones(len(texts))
        if self.odd is not None and len(self.odd):
            far = self.deviation(entropy[at, best], best, n)
            usual = (len(self.odd) - np.searchsorted(self.odd, far) + 1) / (len(self.odd) + 1)
        empty = sizes == 0
        return np.where(empty, -1, best), np.where(empty, 0.0, score), np.where(empty, 0.0, entropy[at, best]), np.where(empty, 0.0, usual)

    def deviation(self, entropy: np.ndarray, language: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How far a cross-entropy is above that of the language's own texts, in deviations for that length."""
        return (entropy - self.center[language]) / self.spread[language] * np.sqrt(n)


def _sample(docs: DataFrame, learn: Column | None, doc_id: str, text: str, lang: str, max_rows: int) -> DataFrame:
    """``lang, text, part``: training texts, the same number of every language; part 0 calibrates.

    The first pass orders hashes of rows, without their texts, and gives one limit per language; the second takes the rows
    below it.
    """
    picked = docs if learn is None else docs.where(learn)
    picked = picked.select(F.col(doc_id).cast("string").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    picked = picked.where(F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}"))).withColumn("at", F.xxhash64("id", "text"))
    with scratch_table(picked.select("lang", "at").distinct(), "language-rows") as hashed:
        sizes = hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("least"))
        share = max(1, max_rows // max(1, sizes.count()))
        # Hashes are spread evenly: below this limit lie about twice as many rows as wanted, of a language of any size.
        limit = F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(2.0 * share + 200.0) / F.col("size"))
        near = hashed.join(F.broadcast(sizes.orderBy("least", "lang").limit(max_rows)), "lang").where(F.col("at") <= limit)
        turn = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
        limits = near.withColumn("turn", turn).where(F.col("turn") <= share).groupBy("lang").agg(F.max("at")).collect()
    limits = docs.sparkSession.createDataFrame([tuple(r) for r in limits], "_lang string, _most bigint")
    taken = picked.join(F.broadcast(limits), (F.col("lang") == F.col("_lang")) & (F.col("at") <= F.col("_most")))
    once = taken.select("lang", "at", "text").dropDuplicates(["lang", "at"])
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    return once.select("lang", "text", (turn % CALIBRATION).alias("part"))


def train_languages(
    docs: DataFrame, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", order: int = 4,
    max_rows: int = MAX_TRAINING_ROWS,
) -> Languages:
    """Fit and calibrate on the rows of ``docs`` for which ``learn`` holds.

    Texts without a letter and rows without a language are left out; of rows with equal id, text and language one counts. At
    most ``max_rows`` texts are used, the same number for each language, whole, so the size of what reaches the driver and is
    broadcast is bounded. Without any such text the result knows no language and answers ``und``.
    """
    with scratch_table(_sample(docs, learn, doc_id, text, lang, max_rows), "language-sample") as sample:
        def count(batches: Batches) -> Batches:
            for batch in slices(batches):
                names = np.array(batch.column("lang").to_pylist(), object)
                for owner, rows in pieces([characters(t, order) for t in batch.column("text").to_pylist()], order):
                    for name in sorted(set(names[owner])):
                        mine = rows[names[owner] == name]
                        _, first, counts = np.unique(hashes(mine), return_index=True, return_counts=True)
                        data, size = np.ascontiguousarray(mine[first], "<u4").tobytes(), 4 * order
                        keys = [data[i : i + size] for i in range(0, len(data), size)]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], ["lang", "gram", "n"])

        counted = sample.where("part <> 0").select("lang", "text").mapInArrow(count, "lang string, gram binary, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        table = counted.toArrow()
        names = np.array(table.column("lang").to_pylist(), object)
        rows = np.frombuffer(b"".join(table.column("gram").to_pylist()), "<u4").reshape(-1, order)
        number = table.column("n").to_numpy()
        known = sorted(set(names.tolist()))
        models = []
        for name in known:
            mine = np.flatnonzero(names == name)
            mine = mine[np.lexsort(rows[mine].T)]
            models.append(fit_model(rows[mine], number[mine]))
        plain = Languages(order, known, models)
        if not known:
            return plain
        return _calibrated(plain, sample.where("part = 0"))


def _calibrated(plain: Languages, sample: DataFrame) -> Languages:
    """Sharpness, centers and spreads from texts that the models have not seen, whole and in pieces."""
    order, known = plain.order, {n: i for i, n in enumerate(plain.names)}

    def measure(batches: Batches) -> Batches:
        for batch in slices(batches, 64):
            cut, own = [], []
            for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                codes = characters(text, order)
                parts = [codes, *(codes[: order - 1 + n] for n in PIECES if len(codes) > order - 1 + n)]
                cut += parts
                own += [known[name]] * len(parts)
            totals, sizes = plain.totals(cut)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(sizes, pa.int64()), pa.array(list(totals), pa.list_(pa.float64()))], ["own", "n", "totals"])

    found = sample.select("lang", "text").mapInArrow(measure, "own int, n bigint, totals array<double>").toArrow()
    own, n = found.column("own").to_numpy(), found.column("n").to_numpy().astype(float)
    if not len(own):
        return plain
    totals = np.array(found.column("totals").to_pylist(), float).reshape(len(own), -1)
    order_ = np.lexsort((totals[:, 0], n, own))
    own, n, totals = own[order_], n[order_], totals[order_]
    entropy = -totals / n[:, None]
    mine = entropy[np.arange(len(own)), own]
    center, spread = np.full(len(plain.names), np.nan), np.full(len(plain.names), np.nan)
    for k in set(own.tolist()):
        at = own == k
        center[k] = np.average(mine[at], weights=n[at])
        spread[k] = max(1e-6, float(np.sqrt(np.mean((mine[at] - center[k]) ** 2 * n[at]))))
    # A language with too few texts to calibrate is held to the mean of the others.
    center, spread = (np.where(np.isnan(x), np.nanmean(x), x) for x in (center, spread))

    def loss(sharpness: float) -> float:
        odds = -sharpness * np.sqrt(n)[:, None] * (entropy - entropy.min(axis=1, keepdims=True))
        return float(np.mean(np.log(np.exp(np.maximum(odds, -700)).sum(axis=1)) - odds[np.arange(len(own)), own]))

    sharpness = min((0.25 * 2 ** (k / 2) for k in range(13)), key=loss)
    plain = Languages(order, plain.names, plain.models, sharpness, center, spread)
    odd = np.sort(plain.deviation(mine, own, n))
    return Languages(order, plain.names, plain.models, sharpness, center, spread, odd)


def identify(docs: DataFrame, languages: Languages, doc_id: str = "doc_id", text: str = "text", reject: float = 0.0) -> DataFrame:
    """``doc_id, lang_pred, score, entropy, usual`` per row of ``docs``, repeated rows and null ids included.

    ``usual`` is the share of calibration texts that fit their own language no better; texts below ``reject`` are ``und``, as
    are texts that are null or have no letter (score 0). With ``reject`` r, about that share of texts of the learned languages
    is rejected. The result depends on the text alone.
    """
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    told = docs.sparkSession.sparkContext.broadcast(languages)

    def run(batches: Batches) -> Batches:
        model = told.value
        for batch in slices(batches, 256):
            best, score, entropy, usual = model.judge([characters(t, model.order) for t in batch.column("text").to_pylist()])
            names = [model.names[b] if b >= 0 and u >= reject else UNKNOWN for b, u in zip(best.tolist(), usual.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(entropy), pa.array(usual)],
                ["doc_id", "lang_pred", "score", "entropy", "usual"],
            )

    return picked.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, entropy double, usual double")
