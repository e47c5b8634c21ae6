"""Messages and memories of the backoff model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from indexward.llm import backoff_lm


def test_blocks_send_fewer_messages_than_blocks_times_blocks(spark, monkeypatch):
    texts = [(i, " ".join(f"w{(i * 37 + j * 11) % 500}" for j in range(60))) for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    stored, store = [], backoff_lm.materialize
    monkeypatch.setattr(backoff_lm, "materialize", lambda df, label: (stored.append(store(df, label)), stored[-1])[1])
    one = {r.doc_id: r for r in backoff_lm.lm_scores(docs, F.lit(True)).collect()}
    many = {r.doc_id: r for r in backoff_lm.lm_scores(docs, F.lit(True), block_bytes=1000).collect()}
    assert len(many) == 80 and all(many[i][:6] == one[i][:6] and many[i].score == pytest.approx(one[i].score) for i in one)
    size = sum(len(t) + 64 for _, t in texts)
    blocks = size // 1000 + 1
    assert blocks > 20 and stored[1].select("bucket").distinct().count() <= blocks // backoff_lm.BLOCKS_A_BUCKET + 1
    assert stored[1].count() <= 2 * blocks * (blocks // backoff_lm.BLOCKS_A_BUCKET + 1)


def test_distinct_values_are_those_of_numpy():
    random = np.random.default_rng(1)
    for values in (random.integers(0, 50, 1000), random.integers(0, 2**63, 1000), np.zeros(0)):
        values = values.astype(np.uint64) * np.uint64(3)
        want = np.unique(values, return_index=True, return_inverse=True)
        assert all(np.array_equal(a, b) for a, b in zip(backoff_lm._distinct(values), want))


def test_words_are_hashed_once():
    hashes = backoff_lm._Hashes()
    assert hashes[b"word"] == backoff_lm.xxhash.xxh64_intdigest(b"word") and list(hashes) == [b"word"]
