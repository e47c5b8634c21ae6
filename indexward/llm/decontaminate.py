"""Benchmark decontamination: a hash set of n-grams of benchmark items against the windows of documents.

DataFrame functions only. Each document is scanned in its own row: the hashes of
its windows are looked up in the set, and only hits leave the row, with their
words, to be compared word by word with the windows of the benchmark. Sizes with
more windows than sets hold are joined by shuffle instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexward.sources.scratch import materialize

from .common import ascii_lower, broadcast_checked, free_name

WINDOW = 13
#: Windows of the benchmark that go into one set (and one broadcast), and that go into sets at all; sizes beyond are joined.
SET_SIZE, SCANNED = 100_000, 800_000
#: Sets that one pass over the documents looks up.
SETS_AT_ONCE = 16
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), _SEPARATORS), ""), F.array().cast("array<string>"))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """Distinct windows ``key, size, words, items`` (sorted ids as text): ``n`` words each, or all words of a shorter item.

    Items without words or with a null text have none. An item that is repeated counts once; one without an id hits words, but
    is not listed.
    """
    words = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text).cast("string")).alias("w")).where("size(w) > 0")
    size = F.least(F.lit(n), F.size("w"))
    windows = words.withColumn("size", size).select(
        "item", "size", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.slice("w", i, F.col("size")))).alias("words")
    )
    grouped = windows.groupBy("size", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return grouped.withColumn("key", F.xxhash64(_hashes(F.col("words"))))


def _joined(table: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """Verified hits ``_row, pos, size, items`` of windows of these sizes: hashes meet by shuffle, then words of what has met.

    One row per document window and size is shuffled, without words.
    """
    windows = windows.where(F.col("size").isin(sizes))
    met = []
    for size in sizes:
        keys = F.expr(f"transform(sequence(0, size(_hash) - {size}), i -> xxhash64(slice(_hash, i + 1, {size})))")
        placed = table.withColumn("_hash", _hashes(F.col("_words"))).where(F.size("_hash") >= size).select("_row", F.posexplode(keys).alias("pos", "key"))
        met.append(placed.select("_row", "pos", F.lit(size).alias("size"), "key"))
    met = reduce(DataFrame.unionByName, met).join(windows.select("key", "size").distinct(), ["key", "size"], "left_semi")
    spots = met.groupBy("_row").agg(F.collect_list(F.struct("pos", "size", "key")).alias("_met"))
    words = F.transform("_met", lambda x: F.struct(x["pos"].alias("pos"), x["size"].alias("size"), x["key"].alias("key"), F.slice("_words", x["pos"] + 1, x["size"]).alias("words")))
    flat = table.select("_row", "_words").join(spots, "_row").select("_row", F.inline(words))
    return flat.join(windows, ["key", "size", "words"]).select("_row", "pos", "size", "items")


def _scan(docs: DataFrame, windows: DataFrame, keep: dict[str, Column], text: str) -> tuple[DataFrame, DataFrame]:
    """A stored table (``_row``, ``keep``, ``n_words``), and the verified hits ``_row, pos, size, items`` of its rows.

    The sizes with the fewest windows go into sets, ``SCANNED`` windows at most; all windows of the other sizes are joined.
    """
    counts = {r["size"]: r["count"] for r in windows.groupBy("size").count().collect()}
    scanned, joined, total = [], [], 0
    for size in sorted(counts, key=lambda k: (counts[k], k)):
        total += counts[size]
        (scanned if total <= SCANNED else joined).append(size)
    sets: dict[int, list[int]] = {}
    in_sets = windows.where(F.col("size").isin(scanned)) if joined else windows
    for r in in_sets.select("key", "size").distinct().collect() if scanned else ():
        sets.setdefault(r["size"], []).append(r["key"])
    scans = [(size, keys[start : start + SET_SIZE]) for size, keys in sorted(sets.items()) for start in range(0, len(keys), SET_SIZE)]
    passes = [scans[start : start + SETS_AT_ONCE] for start in range(0, len(scans), SETS_AT_ONCE)] or [[]]
    n_words = F.size("_words").cast("bigint").alias("n_words")
    base = docs.select(*[c.alias(k) for k, c in keep.items()], words_of(F.col(text).cast("string")).alias("_words"))
    row = F.monotonically_increasing_id()
    if joined or len(passes) > 1:  # all passes and the join need the same row numbers
        base = materialize(base.withColumn("_row", row), "document-words")
        row = F.col("_row")

    none = F.expr("cast(array() as array<struct<pos:int,size:int,key:bigint,words:array<string>>>)")

    def among(keys: list[int]) -> str:
        return ",".join(f"{k}L" if k > -(2**63) else f"(-{2**63 - 1}L - 1L)" for k in keys)

    def hits(size: int, wanted: list[int]) -> Column:
        found = F.expr(
            f"filter(transform(sequence(0, size(_hash) - {size}), i -> named_struct('pos', i, 'key', xxhash64(slice(_hash, i + 1, {size})))), x -> x.key IN ({among(wanted)}))"
        )
        rows = F.transform(found, lambda x: F.struct(x["pos"].alias("pos"), F.lit(size).alias("size"), x["key"].alias("key"), F.slice("_words", x["pos"] + 1, size).alias("words")))
        return F.when(F.size("_hash") >= size, rows).otherwise(none)

    hashed = base.withColumn("_hash", _hashes(F.col("_words")))
    stored = []
    for group in passes:
        found = F.concat(none, *[hits(*s) for s in group]).alias("_hits")
        stored.append(materialize(hashed.select(*([] if stored else [*keep, n_words]), found, row.alias("_row")), "window-hits"))
    flat = reduce(DataFrame.unionByName, [t.where(F.size("_hits") > 0).select("_row", F.inline("_hits")) for t in stored])
    parts = [in_sets] if sum(len(keys) for _, keys in scans) <= SET_SIZE else [in_sets.where(f"size = {size} AND key IN ({among(keys)})") for size, keys in scans]
    sides = [flat.join(F.broadcast(part), ["key", "size", "words"]).select("_row", "pos", "size", "items") for part in parts]
    return stored[0].drop("_hits"), reduce(DataFrame.unionByName, sides + ([_joined(base, windows, joined)] if joined else []))


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    n: int = WINDOW, share: int = 20, also: dict[str, Column] | None = None,
) -> DataFrame:
    """Per row ``doc_id, n_words, n_hit, n_items, items, positions, items_sha256, contaminated``.

    A word is hit inside any occurrence of a window; ``positions`` are the first words of the occurrences. A document is
    contaminated if at least one word in ``share`` is hit. Null and empty texts have no words and are clean; repeated rows
    stay rows of their own; without benchmark windows all documents are clean. ``also`` adds columns of ``docs``.
    """
    windows = materialize(benchmark_windows(benchmark, item, item_text, n), "benchmark-windows")
    keep = {"doc_id": F.col(doc_id), **(also or {})}
    table, hits = _scan(docs, windows, keep, text)
    spots = hits.groupBy("_row").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence("pos", F.col("pos") + F.col("size") - 1))))).cast("bigint").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.collect_set("pos")).alias("positions"),
    )
    found = table.join(spots, "_row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        *keep, "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), items.alias("items"),
        F.coalesce("positions", F.array().cast("array<int>")).alias("positions"),
        F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated rows, all columns kept.

    Contamination depends on the text alone, so the digests of contaminated texts decide.
    """
    name = free_name(docs, "_digest")
    digest = F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))
    flagged = contamination(docs.select(digest.alias("digest"), F.col(text).alias("text")), benchmark, "digest", "text", **options)
    bad = broadcast_checked(materialize(flagged.where("contaminated").select(F.col("doc_id").alias(name)).distinct(), "contaminated"))
    return docs.withColumn(name, digest).join(bad, name, "left_anti").select(*[docs[c] for c in docs.columns])


CONTAMINATION_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS MATERIALIZED (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS x
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT DISTINCT k FROM win),
dw AS MATERIALIZED (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS x
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hit AS MATERIALIZED (SELECT doc_id, k, i, item_id FROM dw JOIN win USING (k, x)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
