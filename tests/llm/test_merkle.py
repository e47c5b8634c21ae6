"""The Merkle manifest against a plain recursion."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from indexward.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, grp string, pos int, digest string, n int, id string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain(nodes):
    """The root of a list, and per node its siblings from the bottom up."""
    if len(nodes) <= 1:
        return nodes[0], [[] for _ in nodes]
    runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
    root, above = plain([h(*run) for run in runs])
    own = [[("".join(run[:k]), "".join(run[k + 1 :]))] + above[i] for i, run in enumerate(runs) for k in range(len(run))]
    return root, own


def expected(rows):
    """``{(id, leaf): (subroot, root, steps)}`` by sorting and recursion."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r[:5])))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain([x for *_, x in sorted(by_source[s])]) for s in names]
    root, above = plain([t[0] for t in trees])
    out = {}
    for name, (subroot, own), over in zip(names, trees, above):
        for (there, i, x), steps in zip(sorted(by_source[name]), own):
            out.setdefault((i if there else None, x), []).append((subroot, root, steps + over))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "g", 1, "d", 2, "i") for r in rows], SCHEMA)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_is_the_plain_tree(spark, height):
    sizes = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 9, "f": 10, None: 28, "é": 55, "": 5, "zz": 82}
    rows = [(100 * k + (7 * i) % 97, s, "en" if i % 3 else None, i if i % 4 else None, f"text {i}\n€" if i % 5 else None) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(None, "a", None, None, None), (5, "a", "x", 1, "1:y"), (5, "a", "x", 1, "1:y"), (5, "a", "x", 1, "other")]
    got = merkle.manifest(table(spark, rows), height=height, carry={"digest": F.length("text"), "id": F.col("lang")}).collect()
    want = expected(rows)
    assert len(got) == len(rows)
    for r in got:
        choices = want[(r["doc_id"], r["leaf"])]
        assert (r["subroot"], r["root"], list(zip(r["before"], r["after"]))) in choices
    assert {(r["source"], r["position"]) for r in got} == {(s, i) for s, n in {**sizes, "a": 5}.items() for i in range(n)}


def test_one_group_of_one_row_and_nothing(spark):
    one = merkle.manifest(table(spark, [(1, None, None, None, None)])).first()
    assert one["leaf"] == one["subroot"] == one["root"] == leaf((1, None, None, None, None)) and one["before"] == one["after"] == []
    assert merkle.manifest(table(spark, [])).count() == 0


def test_folding_finds_what_was_changed(spark):
    rows = [(i, f"s{i % 4}", "en", i, f"line {i}\nnext") for i in range(60)]
    proofs = merkle.manifest(table(spark, rows), height=1)
    changed = [(i, s, a, n, t.replace("\n", "") if zlib.crc32(str(i).encode()) % 2 == 0 else t) for i, s, a, n, t in rows]
    got = merkle.verify(table(spark, [*changed, (99, "s1", "en", 1, "new")]), proofs).collect()
    assert len(got) == 61
    for r in got:
        assert r["verified"] == (r["doc_id"] != 99 and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 1)
        assert (r["folded_root"] is None) == (r["doc_id"] == 99)


def test_the_queue_stays_small(monkeypatch):
    longest = 0
    real = merkle.heapq.heappush

    def push(queue, item):
        nonlocal longest
        real(queue, item)
        longest = max(longest, len(queue))

    monkeypatch.setattr(merkle.heapq, "heappush", push)
    nodes = [str(i) for i in range(2000)]
    *_, (level, top) = merkle.sweep_up(nodes, len(nodes), merkle.levels_of(len(nodes)))
    assert level == 7 and top == plain(nodes)[0] and longest <= 3 * 7


def test_a_very_long_text_and_a_large_group(spark):
    rows = [(i, "hot", None, None, "x" * 3_000_000 if i == 5 else "t") for i in range(2300)]
    got = merkle.manifest(table(spark, rows))
    want = expected(rows)
    assert got.count() == 2300
    some = got.where("doc_id in (0, 5, 728, 729, 2299)").collect()
    assert all((r["subroot"], r["root"], list(zip(r["before"], r["after"]))) in want[(r["doc_id"], r["leaf"])] for r in some)
