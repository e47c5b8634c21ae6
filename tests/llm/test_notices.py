"""Fuzzy notices against edit distances computed plainly."""

import random
import time

import pytest

from indexward.llm.notices import MENTION, NOTICES, NoticeSearch, normalised, scan_licenses

SEARCH = NoticeSearch(NOTICES)
PLAIN = {n.replace("{", "").replace("}", ""): label for n, label in NOTICES.items()}


def distance(a, b):
    """Edit distance of two strings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutated(rng, marked, edits):
    """A notice with some edits outside the words in braces, away from spaces."""
    text, fixed, out = [], [], False
    for c in marked:
        if c in "{}":
            out = c == "{"
        else:
            text.append(c)
            fixed.append(out)
    free = [i for i, c in enumerate(text) if not fixed[i] and c != " " and 0 < i < len(text) - 1 and text[i - 1] != " " and text[i + 1] != " "]
    for i in sorted(rng.sample(free, min(edits, len(free))), reverse=True):
        kind = rng.randrange(3)
        text[i : i + 1] = [[], ["q"], [text[i], "q"]][kind]
    return "".join(text)


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_notices_with_edits_are_found(edits):
    rng = random.Random(edits)
    for marked, label in NOTICES.items():
        plain = marked.replace("{", "").replace("}", "")
        allowed = int((len(plain) + 2) * 0.06)
        if edits > allowed:
            continue
        text = f"some words before it {mutated(rng, marked, edits)} and others behind it"
        found = [m for m in SEARCH.find(normalised(text)[0]) if m.label == label]
        assert found and min(m.edits for m in found) <= edits, (marked, text)


def test_all_matches_are_within_the_edits():
    rng = random.Random(9)
    words = " ".join(PLAIN).split()
    for _ in range(150):
        parts = [mutated(rng, rng.choice(list(NOTICES)), rng.randrange(6)) for _ in range(3)]
        text = normalised(" ".join(x for p in parts for x in (p, *rng.sample(words, 5))))[0]
        for m in SEARCH.find(text):
            stretch = text[m.start : m.end].strip()
            best = min((distance(stretch, n), n) for n, label in PLAIN.items() if label == m.label)
            assert best[0] <= m.edits <= int((m.length + 2) * 0.06) and text[m.start : m.end] == text[m.start : m.end]


@pytest.mark.parametrize("text,labels", [
    ("Licensed under CC BY-ND 4.0", {"cc-by-nd"}), ("Licensed under CC BY-NC-SA 4.0", {"cc-by-nc-sa"}), ("Licensed under CC BY 4.0", {"cc-by"}),
    ("released under the bit license", set()), ("released under the MIT license", {"mit"}), ("Licensed under the GNU Lesser General Public License", {"lgpl"}),
    ("under the terms of the GNU Affero General Public License", {"agpl"}), ("licensed under the apache licence", set()),
    ("licenced under the Apache License, version 2.0", {"apache"}), ("distributed under the ISC license", {"isc"}), ("distributed under the BSD 3-Clause License", {"bsd"}),
    ("licensed under the gnu general public licenses", set()), ("nothing of the kind", set()), ("", set()),
])
def test_the_words_that_name_a_license_stand_exactly(text, labels):
    assert {m.label for m in SEARCH.find(normalised(text)[0])} == labels


def test_long_texts_of_single_pieces_take_little_time():
    start = time.perf_counter()
    assert SEARCH.find(normalised("permission is hereby " * 50_000)[0]) == []
    assert time.perf_counter() - start < 5
    many = SEARCH.find(normalised("licensed under cc by 4 0 and then " * 300)[0])
    assert len({m.start for m in many if m.edits == 0}) == 300


def test_scores_and_labels_of_rows(spark):
    rows = [(1, None), (2, ""), (3, "the MIT license is short"), (4, "Released under the MIT License."), (4, "Released under the MIT License."), (5, "Licenced under the MIT License"), (None, "CC BY")]
    df = spark.createDataFrame([(*r, 0.5, "x", 1) for r in rows], "doc_id bigint, text string, score double, labels string, _text int")
    got = sorted(((r["doc_id"] or 0, r["labels"], r["score"]) for r in scan_licenses(df).collect()))
    assert got[0] == (0, "cc-by", MENTION) and got[1:3] == [(1, "", 0.0), (2, "", 0.0)] and got[3] == (3, "mit", MENTION)
    assert got[4] == got[5] == (4, "mit", 1.0) and got[6][1] == "mit" and 0.9 < got[6][2] < 1
