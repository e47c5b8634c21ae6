"""One query per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexward.sources.scratch import materialize

from .backoff_lm import lm_scores
from .common import fold, in_fold
from .decontaminate import CONTAMINATION_SQL, contamination
from .language import identify, train_languages
from .merkle import MANIFEST_SQL, fold_proof, leaf_of, manifest, siblings, without_line_breaks
from .negatives import NEGATIVES_SQL, hard_negatives
from .notices import scan_licenses
from .piece_prefix import encode_pieces
from .quality import score_quality, train_quality
from .secret_scan import find_secrets, train_markov
from .setsketch import NEAR_SQL, near_duplicates
from .spotsigs import fingerprint_edits
from .token_planes import tokens_roundtrip
from .warc import REVISITS_SQL, read_warc, resolve_revisits, resolved_records, write_deduplicated, write_warc


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quality_training_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from: not those of the held-out fold."""
    return labels.where(~in_fold("doc_id", 3, 1))


def op1_quality_trees(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    trees = train_quality(docs, quality_training_labels(labels))
    return score_quality(docs, trees).select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op2_token_planes(spark: SparkSession, folder: str) -> DataFrame:
    return tokens_roundtrip(spark, _table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_piece_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return encode_pieces(_table(spark, folder, "documents"), path, with_ids=False)


def op4_setsketch_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"), words=3, share=(85, 100))


def op5_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    index = write_warc(_table(spark, folder, "pages"))
    places = write_deduplicated(resolve_revisits(index))
    records = materialize(read_warc(places, with_payload=False), "warc-records")
    return resolved_records(records).withColumnRenamed("key", "page_id")


def op6_spot_signatures(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_edits(_table(spark, folder, "documents"))


def op7_markov_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return find_secrets(docs, train_markov(docs)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_backoff_automaton(spark: SparkSession, folder: str) -> DataFrame:
    scored = lm_scores(_table(spark, folder, "documents"), ~in_fold("doc_id", 7, 2))
    return scored.select("doc_id", (~scored["in_training"]).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_window_set(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.drop("items", "positions")


def op10_fuzzy_notices(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(_table(spark, folder, "documents"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = (fold("doc_id", 2) == 0) & F.contains("text", F.lit("\n"))
    altered = F.when(changed, leaf_of([*columns, without_line_breaks("text")]))
    proofs = manifest(_table(spark, folder, "documents"), carry={"altered": altered})
    folded = proofs.withColumn("folded_root", fold_proof(F.coalesce("altered", "leaf")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings().cast("binary"), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_kneser_ney_language(spark: SparkSession, folder: str) -> DataFrame:
    docs, held_out = _table(spark, folder, "documents"), in_fold("doc_id", 3, 1)
    found = identify(docs, train_languages(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "entropy", "usual")


def op13_bond_negatives(spark: SparkSession, folder: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, folder, "embeddings"), label=noisy)


QUERIES = {
    f.__name__: f
    for f in (op1_quality_trees, op2_token_planes, op3_piece_prefixes, op4_setsketch_groups, op5_warc_revisits, op6_spot_signatures, op7_markov_secrets,
              op8_backoff_automaton, op9_window_set, op10_fuzzy_notices, op11_merkle_manifest,
              op12_kneser_ney_language, op13_bond_negatives)
}

ORACLE_SQL: dict[str, str] = {
    "op4_setsketch_groups": NEAR_SQL, "op5_warc_revisits": REVISITS_SQL, "op9_window_set": CONTAMINATION_SQL,
    "op11_merkle_manifest": MANIFEST_SQL, "op13_bond_negatives": NEGATIVES_SQL,
}
