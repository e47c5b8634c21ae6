"""Hard negatives against brute force."""

import math

import numpy as np
import pytest

from indexward.llm import negatives
from indexward.llm.negatives import Window10, hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, v int, rank int, score string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "s") for r in rows], SCHEMA)


def brute(rows, every=100, positives=5, negatives_=10):
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for k, (i, v, label) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for m, (j, w, other) in enumerate(kept) if m != k]
        near = sorted([(s, j) for s, j, other in scored if other == label], key=order)[:positives]
        for p, j in near:
            hard = sorted([(s, m) for s, m, other in scored if other != label and 30 * p <= 100 * s <= 90 * p], key=order)[:negatives_]
            out += [(i, j, r, m, p, s) for r, (s, m) in enumerate(hard, 1)]
    return out


def vectors(seed, n, dims=12, labels=4):
    rng = np.random.default_rng(seed)
    center = rng.normal(size=(labels, dims))
    return [(i, [float(np.float32(x)) for x in center[i % labels] * 0.5 + rng.normal(size=dims)], int(i % labels)) for i in range(n)]


def sorted_rows(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("block_rows,at_once", [(1024, 4096), (37, 3)])
def test_negatives_are_those_of_brute_force(spark, block_rows, at_once):
    rows = vectors(1, 400)
    got = hard_negatives(table(spark, rows), every=20, block_rows=block_rows, anchors_at_once=at_once)
    assert sorted_rows(tuple(r) for r in got.collect()) == sorted_rows(brute(rows, 20))
    assert len(brute(rows, 20)) > 500


def test_negatives_on_odd_rows(spark):
    rows = vectors(2, 60)
    rows += [(200, None, 1), (300, [1.0, None], 1), (400, [float("nan")] * 12, 2), (500, [float("inf")] * 12, 2), (600, [0.5] * 12, None)]
    rows += [(None, rows[3][1], 3), (None, rows[4][1], 0), (700, [], 0), (800, [0.25, 1.5], 1), (-100, rows[7][1], 3), (40, rows[40][1], 0), (900, [0.0] * 12, 2)]
    rows += [(i, rows[9][1], 2) for i in range(1000, 1012)]  # ties
    got = hard_negatives(table(spark, rows), every=20, block_rows=7, anchors_at_once=2)
    assert sorted_rows(tuple(r) for r in got.collect()) == sorted_rows(brute(rows, 20))


def test_no_anchor_and_no_rows(spark):
    assert hard_negatives(table(spark, vectors(3, 30)[1:])).count() == 0
    assert hard_negatives(table(spark, [])).count() == 0


def test_bounds_drop_rows_before_all_dimensions_are_read(monkeypatch):
    rng = np.random.default_rng(4)
    values = rng.integers(-20, 20, (64, 500)).astype(float)
    values[:8, :50] += 400
    anchor = np.concatenate([np.full(8, 300.0), rng.integers(-10, 10, 56)])
    order = np.argsort(-np.abs(anchor), kind="stable")
    compared = []

    def outside(low, high):
        compared.append(len(low))
        return high < 900_000

    rows, scores = negatives._pruned(values, anchor, order, np.ones(500, bool), outside, values.min(axis=1), values.max(axis=1))
    assert compared[0] == 500 and compared[2] <= 50
    exact = anchor @ values
    assert rows.tolist() == np.flatnonzero(exact >= 900_000).tolist() and (scores == exact[rows]).all()


def test_windows_are_exact_in_integers():
    for p in range(-50, 400):
        low, high = Window10().ends(p)
        assert [s for s in range(-60, 400) if 30 * p <= 100 * s <= 90 * p] == list(range(low, high + 1))


def test_scores_beyond_64_bits_are_an_error(spark):
    rows = [(0, [3e16, 1.0], 1), (1, [3e16, 1.0], 1), (2, [1.0, 2.0], 2)]
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives(table(spark, rows)).collect()
