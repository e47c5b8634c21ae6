"""Character models against plain Kneser-Ney, and their answers on held-out texts."""

import collections
import math
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from indexward.llm import language
from indexward.llm import queries as Q
from indexward.llm.common import in_fold
from indexward.llm.language import Languages, characters, fit_model, grams, identify, train_languages

SCHEMA = "doc_id bigint, text string, lang string, score string, at int, part string, `_lang` int, `_most` int"
WORDS = {
    "aa": "the cat sat on the mat and the dog ran to the old house in the wood".split(),
    "bb": "der hund und die katze sind im alten haus mit einem grossen garten".split(),
    "cc": "кот и собака живут в старом доме у большого леса на реке".split(),
}


def texts(n, seed=0):
    rng = np.random.default_rng(seed)
    names = sorted(WORDS)
    return [(i, " ".join(rng.choice(WORDS[names[i % 3]], 5 + i % 30)), names[i % 3]) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, "p", 2, 3) for r in rows], SCHEMA)


def string(codes):
    return "".join(map(chr, codes))


def plain_model(counts, order):
    """Interpolated Kneser-Ney with dicts of strings: a function of n-gram to probability."""
    levels = [counts]
    for _ in range(order - 1):
        lower = collections.Counter()
        for gram in levels[0]:
            lower[gram[1:]] += 1
        levels.insert(0, lower)
    size = len(levels[0])

    def probability(gram):
        k = len(gram)
        if not k:
            return 1 / (size + 1)
        c = levels[k - 1]
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = n1 / (n1 + 2 * n2) if n1 else 0.1
        same = [v for g, v in c.items() if g[:-1] == gram[:-1]]
        if not same:
            return probability(gram[1:])
        return (max(c.get(gram, 0) - d, 0) + d * len(same) * probability(gram[1:])) / sum(same)

    return probability


@pytest.mark.parametrize("order", [1, 2, 4])
def test_models_are_interpolated_kneser_ney(order):
    counts = collections.Counter()
    for _, t, lang in texts(30):
        if lang == "aa":
            counts.update(string(g) for g in grams(characters(t, order), order))
    keys = sorted(counts)
    model = fit_model(np.array([[ord(c) for c in k] for k in keys], np.uint32), np.array([counts[k] for k in keys]))
    probability = plain_model(counts, order)
    probes = keys[:60] + [string(g) for g in grams(characters("a quick zebra ran to the dog; äh?", order), order)]
    got = model.log_probability(np.array([[ord(c) for c in k] for k in probes], np.uint32))
    assert np.allclose(got, [math.log(probability(k)) for k in probes])
    # The known characters and one unknown have all of the probability after any context.
    alphabet = sorted({k[-1] for k in keys})
    for context in {k[:-1] for k in probes}:
        rows = np.array([[ord(c) for c in context + a] for a in [*alphabet, "￿"]], np.uint32)
        assert math.isclose(np.exp(model.log_probability(rows)).sum(), 1, rel_tol=1e-9)


def test_characters():
    assert string(characters("  Ein  HAUS,\n12 Ä!", 3)) == "  ein haus ä "
    assert not len(characters("12 ,.\n", 3)) and not len(characters("", 3)) and not len(characters("́", 3))
    assert string(characters("İx", 1)) == "İx" and string(characters("日本", 1)) == "日本"


def test_held_out_languages_are_found(spark):
    folder = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: r for r in Q.op12_kneser_ney_language(spark, folder).collect()}
    assert len(got) == len(docs)
    held = 0
    for i, text, lang in zip(docs.doc_id, docs.text, docs.lang):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i]["score"] <= 1
        if got[i]["held_out"] and any(c.isalpha() for c in text or ""):
            held += 1
            got[i] = got[i]["lang_pred"] == lang
    right = sum(v is True for v in got.values())
    assert held > 250 and right >= 0.95 * held


def test_odd_rows(spark):
    rows = texts(90) + [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 ?!", "cc"), (None, "the cat sat", "aa"), (1003, "x", None), (1004, "the dog " * 30_000, "zz")]
    rows += [(5, "der hund und die katze", "bb"), (5, "der hund und die katze", "bb"), (5, "the cat", None)]
    docs = table(spark, rows)
    model = train_languages(docs)
    assert model.names == ["aa", "bb", "cc", "zz"]
    got = identify(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] in (1000, 1001, 1002):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in model.names and 0.25 <= r["score"] <= 1
    assert identify(table(spark, []), model).count() == 0
    nothing = train_languages(table(spark, []))
    assert nothing.names == [] and {r["lang_pred"] for r in identify(docs, nothing).collect()} == {"und"}


def test_only_rows_to_learn_from_count(spark):
    rows = texts(300)
    wrong = [(i, t, lang if zlib.crc32(str(i).encode()) % 3 != 1 else "wrong") for i, t, lang in rows]
    model = train_languages(table(spark, wrong), ~in_fold("doc_id", 3, 1))
    assert model.names == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r["lang_pred"] for r in identify(table(spark, rows), model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_the_sample_is_bounded_and_even(spark):
    rows = [(i, f"the cat {i}", "aa") for i in range(400)] + [(1000 + i, f"der hund {i}", "bb") for i in range(30)] + [(7, "the cat 7", "aa")] * 50
    taken = language._sample(table(spark, rows), None, "doc_id", "text", "lang", 40).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in taken} == {"aa": 20, "bb": 20}
    many = table(spark, [(i, "abc", f"l{i}") for i in range(50)])
    assert language._sample(many, None, "doc_id", "text", "lang", 40).count() == 40


def test_long_texts_are_scored_in_pieces(monkeypatch):
    model = fit_model(grams(characters("the cat sat on the mat", 4), 4).copy(), np.ones(22, np.int64))
    plain = Languages(4, ["aa"], [model])
    cut = [characters("the cat " * 50, 4), characters("", 4), characters("mat", 4)]
    whole = plain.totals(cut)
    real = language.pieces
    monkeypatch.setattr(language, "pieces", lambda t, o: real(t, o, 7))
    assert np.allclose(whole[0], plain.totals(cut)[0]) and whole[1].tolist() == [400, 0, 3]


def test_rejection_is_calibrated(spark):
    rows = texts(900)
    docs = table(spark, rows)
    model = train_languages(docs, F.col("doc_id") < 600)
    new = docs.where("doc_id >= 600")
    rejected = identify(new, model, reject=0.1).where("lang_pred = 'und'").count()
    assert 3 <= rejected <= 75
    strange = table(spark, [(1, "ξενος λογος αγνωστος εις παντας τους ανθρωπους", None), (2, "qzx jqv wkx zzq xqj vvq kqz", None)])
    assert {r["lang_pred"] for r in identify(strange, model, reject=0.05).collect()} == {"und"}
    assert all(r["lang_pred"] != "und" and r["usual"] < 0.05 for r in identify(strange, model).collect())
