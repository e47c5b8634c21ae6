"""Document fingerprints from spot signatures. DataFrame functions only.

A signature is an anchor (a common word) with the chain of content words that
follow it; where a text has no anchors for a while, every word starts a chain.
The fingerprint of a text is the set of its signatures. Fingerprints are compared
by Jaccard likeness. Sizes alone rule out most pairs: sets are partitioned by
length, and only neighbouring partitions meet, by their rarest signatures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .setsketch import Tables, components

#: Common words of the languages at hand that start a chain.
ANCHORS = tuple(
    "a an and are as at be by for from in is it of on or that the this to was with "
    "der die das den dem des ein eine ist im mit nicht und von zu auf für sich auch "
    "le la les des du de un une et est en que qui pour dans par sur au aux plus "
    "el los las una y es se su por con para del al lo como".split()
)
CHAIN, REACH = 3, 8
#: Rows of neighbouring ids that are ordered together, and cuts of the ids by quantiles.
BUCKET_ROWS, CUTS = 256, 128


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def signatures(words: str, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN, reach: int = REACH) -> Column:
    """Sorted distinct signature hashes of a column of words.

    The chain of an anchor is the first ``chain`` words that are no anchors among the ``reach`` words after it. A word with no
    anchor among the ``chain`` words before it starts a chain of the words that follow, so no part of a text is left out and
    only texts without words have no signatures.
    """
    listed = ",".join("'" + a.replace("'", "''") + "'" for a in sorted(set(anchors)))
    after_anchor = f"hash(w, slice(filter(slice({words}, i + 2, {reach}), x -> x NOT IN ({listed})), 1, {chain}))"
    alone = f"NOT array_contains(slice(_is_anchor, greatest(i + 1 - {chain}, 1), least(i, {chain})), true)"
    spot = f"IF(element_at(_is_anchor, i + 1), {after_anchor}, IF({alone}, hash(w, slice({words}, i + 2, {chain})), NULL))"
    spots = f"filter(transform({words}, (w, i) -> {spot}), h -> h IS NOT NULL)".replace("_is_anchor", f"_is_anchor_{words}")
    return F.array_sort(F.array_distinct(F.expr(spots)))


def with_signatures(df: DataFrame, text: str, name: str, anchors: tuple[str, ...] = ANCHORS, **options) -> DataFrame:
    """``df`` with the signatures of a text column."""
    words = f"_words_{name}"
    flags = F.transform(F.col(words), lambda w: w.isin(*sorted(set(anchors))))
    rows = df.withColumn(words, _words(F.col(text))).withColumn(f"_is_anchor_{words}", flags)
    return rows.withColumn(name, signatures(words, anchors, **options)).drop(words, f"_is_anchor_{words}")


def fingerprint_text(signs: Column) -> Column:
    """A fingerprint as text."""
    return F.array_join(signs.cast("array<string>"), " ")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two fingerprints, 1 for two empty ones.

    Where the sizes alone keep it below ``least`` the sets are not compared and it is 0.
    """
    smaller, larger = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    jaccard = common / (F.size(a) + F.size(b) - common)
    return F.when(larger == 0, F.lit(1.0)).when(smaller == 0, F.lit(0.0)).when(smaller < least * larger, F.lit(0.0)).otherwise(jaccard)


def previous_buckets(buckets: DataFrame) -> DataFrame:
    """``cut, cell, before_cut, before_cell`` for the distinct buckets: the one before, and for the first the last.

    Ordered inside each cut; one row per cut is ordered in one task.
    """
    distinct = buckets.select("cut", "cell").distinct()
    inside = distinct.withColumn("before", F.lag("cell").over(Window.partitionBy("cut").orderBy("cell")))
    ends = distinct.groupBy("cut").agg(F.max("cell").alias("last"))
    order, last = Window.orderBy("cut"), F.struct("cut", "last")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("cut", F.coalesce(F.lag(last).over(order), F.max(last).over(whole)).alias("wrap"))
    first = F.col("before").isNull()
    return inside.join(ends, "cut").select(
        "cut", "cell", F.when(first, F.col("wrap.cut")).otherwise(F.col("cut")).alias("before_cut"),
        F.when(first, F.col("wrap.last")).otherwise(F.col("before")).alias("before_cell"),
    )


def buckets_of(docs: DataFrame, doc_id: str, rows: int = BUCKET_ROWS, cuts: int = CUTS) -> tuple[Column, Column]:
    """``cut, cell`` of an id: ascending ids have ascending pairs, and a pair has about ``rows`` rows where ids are spread evenly.

    Quantiles cut the ids, so dense and sparse stretches get cuts of their own; a cut is parted evenly into cells. Null ids
    come first. Rows with one and the same id share a cell.
    """
    shares = F.array(*[F.lit(i / cuts) for i in range(cuts + 1)])
    found = docs.agg(F.approx_percentile(doc_id, shares, F.lit(10_000)).alias("at"), F.count(F.lit(1)).alias("n")).first()
    bounds = sorted(set(found["at"] or [0]))
    cells = max(1, -(-found["n"] // (rows * len(bounds))))
    at, id_ = F.array(*[F.lit(b).cast("bigint") for b in bounds]), F.col(doc_id)
    cut = F.when(id_.isNull(), F.lit(-1)).otherwise(F.size(F.filter(at, lambda b: b <= id_)))
    low = F.element_at(at, F.greatest(cut, F.lit(1))).cast("double")
    high = F.element_at(at, F.least(F.greatest(cut, F.lit(0)) + 1, F.lit(len(bounds)))).cast("double")
    inside = F.when(high > low, F.floor((id_.cast("double") - low) / (high - low) * cells)).otherwise(F.lit(0))
    outside = (cut < 1) | (cut >= len(bounds))
    return cut, F.when(outside, F.lit(0)).otherwise(F.least(F.greatest(inside, F.lit(0)), F.lit(cells - 1))).cast("bigint")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id, text, signs`` and the same of the next document, ``next_text, next_signs``, by ascending id.

    The first document follows the last. Null ids come first; repeated ids are ordered by their text. Texts are shuffled
    once, by buckets of neighbouring ids; the last document of a bucket gets the first one of the next bucket.
    """
    cut, cell = buckets_of(docs, doc_id)
    placed = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), cut.alias("cut"), cell.alias("cell")
    ).repartition("cut", "cell")
    order = Window.partitionBy("cut", "cell").orderBy("doc_id", "text")
    signed = with_signatures(placed, "text", "signs", **options)
    inner = signed.withColumns({"_text": F.lead("text").over(order), "_signs": F.lead("signs").over(order)})
    first = placed.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("cut", "cell", "text")
    first = with_signatures(first, "text", "signs", **options)
    before = previous_buckets(docs.select(cut.alias("cut"), cell.alias("cell")))
    edge = first.join(before, ["cut", "cell"]).select(
        F.col("before_cut").alias("cut"), F.col("before_cell").alias("cell"), F.col("text").alias("_edge_text"), F.col("signs").alias("_edge_signs")
    )
    return inner.join(edge, ["cut", "cell"]).select(
        "doc_id", "text", "signs", F.coalesce("_text", "_edge_text").alias("next_text"),
        F.when(F.col("_text").isNull(), F.col("_edge_signs")).otherwise(F.col("_signs")).alias("next_signs"),
    )


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Fingerprints of texts and of edited texts, and their likeness.

    The edited text has its last ``floor(n / 2)`` code points replaced by as many (or all) first ones of the next text.
    Columns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. A null text counts
    as empty and has an empty fingerprint; two empty fingerprints have the likeness 1. Repeated rows stay.
    """
    rows = with_next(docs, doc_id, text, **options).withColumn("n_chars", F.char_length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_signatures(rows.withColumn("edited", edited), "edited", "edited_signs", **options)
    return rows.select(
        "doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("signs")).alias("fingerprint"), fingerprint_text(F.col("edited_signs")).alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"), likeness(F.col("signs"), F.col("next_signs")).alias("near_next"),
    )


def _linked(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs ``a, b`` with ``of * intersection >= per * union``."""
    per, of = share
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("signs").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("signs").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(of * common >= per * (F.size("x") + F.size("y") - common)).select("a", "b")


def length_blocks(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``sign, part, node, n``: blocks in which every pair of sets that can be alike meets; ``sets`` has ``node, signs, n``.

    Lengths are parted so that a set can only be alike to sets of its own and the two neighbouring partitions: it stands in the
    blocks of its own and, as a guest, in those of the partition below. Two alike sets share one of the rarest signatures of
    each, of which there are one more than may differ, so a set stands in the blocks of these only.
    """
    per, of = share
    part = F.floor(F.log(F.col("n")) / F.log(F.lit(of / per)) + 1e-9).cast("int")
    each = sets.select("node", "n", F.explode("signs").alias("sign"))
    ranked = each.join(each.groupBy("sign").agg(F.count(F.lit(1)).alias("uses")), "sign").where("uses > 1 OR n = 1")
    # Signatures that one set alone has are its rarest; they meet nothing and only count against the number taken.
    may_differ = F.col("n") - F.ceil(F.col("n") * F.lit(per) / F.lit(of)) + 1
    listed = ranked.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("uses", "sign"))).alias("shared"))
    left = F.greatest(F.lit(0), may_differ - (F.col("n") - F.size("shared"))).cast("int")
    rare = listed.select("node", "n", part.alias("own"), F.explode(F.slice("shared", F.lit(1), left)).alias("r"))
    return rare.select("node", "n", "r.sign", F.explode(F.array("own", F.col("own") - 1)).alias("part"))


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: tuple[int, int] = (80, 100), **options) -> DataFrame:
    """``doc_id, n_signatures, class_id`` per row: documents whose fingerprints are alike, directly or over others, share a class.

    Two fingerprints are alike if ``share[1] * intersection >= share[0] * union``; ``class_id`` is the smallest id of a class.
    Equal fingerprints are one from the start. In each block all sets are held against one first; only where a block then still
    holds several classes are sets of different classes compared. Texts without signatures are alike to nothing. Null ids take
    part, but name no class unless all of it are null; repeated rows stay.
    """
    per, of = share
    tables = Tables(docs)
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    signed = with_signatures(picked, "_text", "signs", **options).select("doc_id", "signs", F.size("signs").alias("n"))
    rows = tables.write(signed.withColumn("node", F.when(F.col("n") > 0, F.xxhash64("signs"))), "signed")
    sets = tables.write(rows.where("n > 0").select("node", "signs", "n").dropDuplicates(["node"]), "sets")
    blocks = length_blocks(sets, share)
    hubs = blocks.groupBy("sign", "part").agg(F.min("node").alias("hub"), F.min_by("n", "node").alias("hub_n"), F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = tables.write(blocks.join(hubs, ["sign", "part"]), "blocks")
    close = f"{of} * least({{0}}, {{1}}) >= {per} * greatest({{0}}, {{1}})"
    star = blocks.where("node <> hub AND " + close.format("n", "hub_n")).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = tables.write(_linked(star, sets, share), "links")
    found = components(links, tables)
    mixed = blocks.join(found, "node", "left").select("sign", "part", "node", "n", F.coalesce("comp", "node").alias("comp"))
    split = mixed.groupBy("sign", "part").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").drop("x", "y")
    mixed = tables.write(mixed.join(split, ["sign", "part"]), "mixed")
    a, b = (mixed.select("sign", "part", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "comp")]) for x in "ab")
    across = a.join(b, ["sign", "part"]).where("node_a < node_b AND comp_a <> comp_b AND " + close.format("n_a", "n_b"))
    pairs = across.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    links = tables.write(links.unionByName(_linked(pairs, sets, share)), "links")
    found = components(links, tables)
    named = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("id")).join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = named.groupBy("comp").agg(F.min("id").alias("class_id"))
    of_node = tables.write(named.join(names, "comp").select("node", "class_id"), "names")
    tables.drop("sets", "blocks", "links", "mixed", "components")
    out = rows.join(of_node, "node", "left")
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_signatures"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))
