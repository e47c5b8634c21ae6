"""Spot signatures against a plain computation, and classes of alike fingerprints against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from indexward.llm import spotsigs
from indexward.llm.spotsigs import ANCHORS, buckets_of, fingerprint_edits, near_classes, with_next, with_signatures

FOLDER = "/root/testdata/sf0.001"


def chains(words, chain=3, reach=8):
    """The chains of a list of words, as tuples."""
    out = set()
    for i, w in enumerate(words):
        if w in ANCHORS:
            out.add((w, *[x for x in words[i + 1 : i + 1 + reach] if x not in ANCHORS][:chain]))
        elif not any(x in ANCHORS for x in words[max(0, i - chain) : i]):
            out.add((w, *words[i + 1 : i + 1 + chain]))
    return out


def hashed(spark, all_chains):
    """The hash of each chain, by Spark."""
    rows = spark.createDataFrame([(c[0], list(c[1:])) for c in sorted(all_chains)], "w string, r array<string>")
    return {(r["w"], *r["r"]): r["h"] for r in rows.select("w", "r", F.hash("w", "r").alias("h")).collect()}


def words_of(text):
    import regex

    return [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]


def test_fingerprints_are_the_plain_chains(spark):
    texts = pd.read_parquet(f"{FOLDER}/documents.parquet").text.fillna("").tolist()[:60]
    texts += ["", "?", "the", "alpha", "alpha beta gamma delta the end of it", "x " * 40 + "the y", "the the the", "über das Haus; EIN Wort", "a " + "w " * 30]
    want = [chains(words_of(t)) for t in texts]
    codes = hashed(spark, set().union(*want))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in with_signatures(df, "text", "signs").collect():
        assert r["signs"] == sorted({codes[c] for c in want[r["i"]]})


def test_no_part_of_a_text_is_left_out(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    for i in rng.choice(300, 12, replace=False):
        words[i] = "the"
    changed = [(-1, " ".join(words))]
    for i in range(300):
        if words[i] != "the":
            changed.append((i, " ".join([*words[:i], "other", *words[i + 1 :]])))
    prints = {r["i"]: r["signs"] for r in with_signatures(spark.createDataFrame(changed, "i int, text string"), "text", "signs").collect()}
    assert all(p != prints[-1] for i, p in prints.items() if i >= 0)


@pytest.mark.parametrize("ids", ["dense", "sparse", "odd"])
def test_neighbours_of_any_ids(spark, monkeypatch, ids):
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 8)
    rng = np.random.default_rng(2)
    numbers = {
        "dense": list(range(700)), "sparse": [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 700)],
        "odd": [None] * 30 + [5] * 40 + [2**62, -(2**62)] + list(range(100, 400)) + [10**15 + 7 * i for i in range(200)],
    }[ids]
    rows = [(i, f"text {k}") for k, i in enumerate(numbers)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = sorted((t, ordered[(n + 1) % len(ordered)][1]) for n, (_, t) in enumerate(ordered))
    assert sorted((r["text"], r["next_text"]) for r in with_next(df).collect()) == want
    cut, cell = buckets_of(df, "doc_id", 8)
    sizes = [r["count"] for r in df.where("doc_id <> 5").groupBy(cut, cell).count().collect()]
    assert max(sizes) <= 64 and len(sizes) >= 20


def brute(rows, share):
    sets = [(i, frozenset(chains(words_of(t or "")))) for i, t in rows]
    top = list(range(len(sets)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and share[1] * len(x & y) >= share[0] * len(x | y):
                top[root(a)] = root(b)
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[m][0] for m in range(len(sets)) if root(m) == root(k) and sets[m][0] is not None]
        out.append((i, len(s), min(ids, default=None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("share", [(80, 100), (60, 100)])
def test_classes_are_those_of_brute_force(spark, share):
    rng = np.random.default_rng(3)
    rows = []
    for family in range(12):
        base = [str(w) for w in rng.choice(["the", "of", "and", *[f"f{family}w{k}" for k in range(60)]], 20 + 12 * family)]
        for copy in range(9):
            words = list(base)
            for k in rng.choice(len(words), rng.integers(0, 2 + len(words) // 14), replace=False):
                words[k] = f"x{family}{copy}{k}"
            rows.append((len(rows), " ".join(words[: len(words) - int(rng.integers(0, 4))])))
    rows += [(900, None), (901, ""), (902, "?"), (None, rows[0][1]), (903, rows[5][1]), (903, rows[30][1]), (904, "alone"), (905, "alone")]
    got = near_classes(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, node int, signs int"), share=share).collect()
    assert sorted(((r["doc_id"], r["n_signatures"], r["class_id"]) for r in got), key=repr) == brute(rows, share)


def test_classes_of_nothing(spark):
    assert near_classes(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_one_id_on_several_texts(spark):
    rows = [(1, "the cat sat"), (1, "a dog ran"), (2, "the end")]
    got = fingerprint_edits(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 2] and len({r["fingerprint"] for r in got}) == 3
