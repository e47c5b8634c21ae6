"""Secret scans: patterns, and character Markov models of random strings against ordinary text.

Long runs of secret-like characters are scored by the log-likelihood ratio of
two first-order Markov models: as a whole, in parts between separators, and by
their highest-scoring stretches. Both are trained from samples labelled by the
patterns over all documents: what a pattern finds is random, all else ordinary.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, map_texts, remembers, slices

KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_SEPARATORS = "/=._+-"
_PART = re.compile(r"[^/=._+-]+")
#: A stretch ends where its sum of log ratios has fallen by so much from its peak, and grows to the separators around it for less.
FALL = 7.0
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_CODE = np.full(256, -1, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
_N = len(ALPHABET)

Span = tuple[int, int, int]  # start, number of the kind, end


def pattern_spans(text: str) -> list[Span]:
    """What the patterns find, per kind leftmost and without overlap; positions in code points."""
    spans: list[Span] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    for run in _RUN.finditer(text):
        a, b = run.span()
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text, a, b)]
        spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text, a, b)]
    return sorted(spans)


@dataclass(frozen=True)
class MarkovModels:
    """Log-likelihood ratios: of a first character, and of a character after another."""

    first: np.ndarray
    step: np.ndarray

    @staticmethod
    def of(random: np.ndarray, ordinary: np.ndarray, random_first: np.ndarray, ordinary_first: np.ndarray) -> MarkovModels:
        """From counts, smoothed by how often a character stands at all; without samples all strings have the ratio 0."""
        def log(pairs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            single = pairs.sum(axis=0) + first + 1.0
            single = single / single.sum()
            return (
                np.log((first + 10.0 * single) / (first.sum() + 10.0)),
                np.log((pairs + 10.0 * single) / (pairs.sum(axis=1, keepdims=True) + 10.0)),
            )

        (a, b), (c, d) = log(random, random_first), log(ordinary, ordinary_first)
        return MarkovModels(a - c, b - d)

    def ratio(self, run: str) -> float:
        """Sum of the log ratios along a string of the alphabet."""
        return float(self.ratios(run).sum())

    def ratios(self, run: str) -> np.ndarray:
        """The log ratio of each character of a string of the alphabet."""
        code = _CODE[np.frombuffer(run.encode(), np.uint8)]
        return np.concatenate([self.first[code[:1]], self.step[code[:-1], code[1:]]])


def _counts(texts: list[str]) -> np.ndarray:
    """Counts of pairs, then of first characters, for random and for ordinary samples."""
    total = np.zeros((2, _N * _N + _N), np.int64)

    def add(kind: int, data: np.ndarray) -> None:
        code = _CODE[data]
        start, inside = code[1:][(code[:-1] < 0) & (code[1:] >= 0)], (code[:-1] >= 0) & (code[1:] >= 0)
        total[kind, : _N * _N] += np.bincount(code[:-1][inside] * _N + code[1:][inside], minlength=_N * _N)
        total[kind, _N * _N :] += np.bincount(start, minlength=_N)

    plain, found = [], []
    for text in texts:
        spans = pattern_spans(text)
        at = 0
        for start, _, end in spans:
            value = text[start:end]
            m = _ASSIGN.fullmatch(value)
            found.append(m.group(2) if m else value)
            plain.append(text[at : max(at, start)])
            at = max(at, end)
        plain.append(text[at:] if at else text)
    for kind, pieces in ((0, found), (1, plain)):
        add(kind, np.frombuffer((" " + " ".join(pieces) + " ").encode("utf-8", "replace"), np.uint8))
    return total


def train_markov(docs: DataFrame, text: str = "text") -> MarkovModels:
    """Both models, from all whole texts (null: empty). What reaches the driver is one number per pair of characters."""

    def count(batches: Batches) -> Batches:
        remembers("secrets")
        total = np.zeros((2, _N * _N + _N), np.int64)
        for batch in slices(batches):
            total += _counts([t or "" for t in batch.column(0).to_pylist()])
        kind, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(at), pa.array(total[kind, at])], ["kind", "at", "n"])

    rows = (
        docs.select(F.col(text).cast("string").alias("_text")).mapInArrow(count, "kind bigint, at bigint, n bigint")
        .groupBy("kind", "at").agg(F.sum("n").alias("n")).collect()
    )
    total = np.zeros((2, _N * _N + _N))
    for r in rows:
        total[r["kind"], r["at"]] = r["n"]
    pairs, first = total[:, : _N * _N].reshape(2, _N, _N), total[:, _N * _N :]
    return MarkovModels.of(pairs[0], pairs[1], first[0], first[1])


def _stretches(score: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Stretches whose sum is at least ``least`` and never falls by ``FALL`` from its peak inside, from left to right, disjoint."""
    sums = np.concatenate([[0.0], np.cumsum(score)])
    if (sums - np.minimum.accumulate(sums)).max() < least:
        return []
    found, start, end, low, peak = [], 0, 0, 0.0, 0.0
    for i, x in enumerate(sums.tolist()):
        if x > peak:
            end, peak = i, x
        if x <= low or peak - x >= FALL:
            if peak - low >= least:
                found.append((start, end))
            start, end, low, peak = i, i, x, x
    return found + [(start, end)] * (peak - low >= least)


def random_parts(run: str, models: MarkovModels, least: float, per_char: float) -> list[tuple[int, int]]:
    """What the models call random in a run: all of it, or the union of its parts between separators and its best stretches.

    Each has a sum of log ratios of at least ``least``, and ``per_char`` per character before it grows to separators.
    """
    if not run:
        return []
    score = models.ratios(run)
    sums = np.concatenate([[0.0], np.cumsum(score)])
    if sums[-1] >= least and sums[-1] >= per_char * len(run):
        return [(0, len(run))]
    found = []
    for a, b in (m.span() for m in _PART.finditer(run)):
        ratio = models.first[_CODE[ord(run[a])]] + sums[b] - sums[a + 1]
        if ratio >= least and ratio >= per_char * (b - a):
            found.append((a, b))
    for a, b in _stretches(score, least):
        if sums[b] - sums[a] < per_char * (b - a):
            continue
        left = max(run.rfind(c, 0, a) for c in _SEPARATORS) + 1 if run[a] not in _SEPARATORS else a
        right = min(min((run + _SEPARATORS).find(c, b) for c in _SEPARATORS), len(run)) if run[b - 1] not in _SEPARATORS else b
        a = left if sums[a] - sums[left] > -FALL else a
        b = right if sums[right] - sums[b] > -FALL else b
        found.append((a, b))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def all_spans(text: str, models: MarkovModels, least: float, per_char: float) -> list[Span]:
    """Spans of the patterns, and what the models call random in the rest of the runs that no pattern span covers."""
    spans = pattern_spans(text)
    found = []
    for run in _RUN.finditer(text):
        at, end = run.span()
        for s, e in [*((s, e) for s, _, e in spans if s < end and e > at), (end, end)]:
            found += [(at + a, 3, at + b) for a, b in random_parts(text[at : max(at, s)], models, least, per_char)]
            at = max(at, e)
    return sorted(spans + found)


def listed(spans: list[Span]) -> str:
    """``kind:start:end`` by start, then kind."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(
    docs: DataFrame, models: MarkovModels, doc_id: str = "doc_id", text: str = "text", least: float = 20.0, per_char: float = 0.8,
) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans`` per row of ``docs``.

    Whole texts; a null or empty text has no spans (and the hash of an empty list). Repeated rows stay rows of their own.
    """

    def make():
        remembers("secrets")

        def work(texts: list[str]) -> dict[str, list]:
            every = [all_spans(t, models, least, per_char) for t in texts]
            out: dict[str, list] = {f"n_{k}": [sum(1 for s in e if s[1] == i) for e in every] for i, k in enumerate(KINDS)}
            out["base_sha256"] = [hashlib.sha256(listed([s for s in e if s[1] < 3]).encode()).hexdigest() for e in every]
            out["spans"] = [listed(e) for e in every]
            return out

        return work

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return map_texts(docs, {"doc_id": doc_id}, text, f"{counts}, base_sha256 string, spans string", make)


def redact_secrets(
    docs: DataFrame, models: MarkovModels, text: str = "text", n_chars: str | None = "n_chars", mark: str = "[secret]",
    least: float = 20.0, per_char: float = 0.8,
) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans by one) and ``n_chars`` counted again where a text changed.

    All rows and columns stay; null texts stay null.
    """
    names = [c.lower() for c in docs.columns]
    at = names.index(text.lower())
    length_at = names.index(n_chars.lower()) if n_chars and n_chars.lower() in names else None

    def redacted(t: str | None) -> str | None:
        spans = all_spans(t, models, least, per_char) if t else []
        if not spans:
            return t
        out, end = [], 0
        for start, _, stop in spans:
            if start >= end:
                out += [t[end:start], mark]
            end = max(end, stop)
        return "".join(out) + t[end:]

    def run(batches: Batches) -> Batches:
        remembers("secrets")
        for batch in slices(batches):
            old = batch.column(at).to_pylist()
            new = [redacted(t) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.column(at).type)
            if length_at is not None:
                lengths = batch.column(length_at)
                columns[length_at] = pa.array([len(b) if a != b else n for a, b, n in zip(old, new, lengths.to_pylist())], lengths.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
