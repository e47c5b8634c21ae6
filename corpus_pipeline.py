"""The corpus pipeline: its stages, and a run over all documents.

Each stage takes all rows that the stage before it kept. The first four return
the columns of ``documents``; the last returns what encoding and decoding give.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from indexward.llm.decontaminate import drop_contaminated
from indexward.llm.piece_prefix import encode_pieces
from indexward.llm.quality import keep_good, train_quality
from indexward.llm.queries import quality_training_labels
from indexward.llm.secret_scan import redact_secrets, train_markov
from indexward.llm.setsketch import drop_near_duplicates
from indexward.sources.scratch import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = quality_training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_good(docs, train_quality(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, likeness of 0.8 or more."""
    return drop_near_duplicates(docs, words=5, share=(80, 100))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in windows of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return redact_secrets(docs, train_markov(docs))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the ids, and digest of the decoded text, per document."""
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("pieces", pieces),
]

#: The first and the last stages cannot be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
