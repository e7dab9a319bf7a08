"""The filter's error rate does not depend on the number of keys."""

import inspect
import zlib

import numpy as np
import pytest
from test_ngrams_whole import plain_scores

from planlens.llm import ngrams


def test_error_rate_is_the_same_at_every_size():
    assert "max_bits" not in inspect.signature(ngrams.score).parameters
    rng = np.random.default_rng(3)
    absent = rng.integers(0, 1 << 62, 20_000)
    for n in (1_000, 50_000, 1_000_000):
        bloom = ngrams.LogBloom.of(rng.integers(0, 1 << 62, n), np.ones(n, np.int64))
        assert (bloom.counts(absent) > 0).mean() < 0.03


def test_parts_follow_the_pairs(spark):
    """With many small parts a pair that is not in training is still almost never found."""
    rng = np.random.default_rng(4)
    ids = [next(d for d in range(100) if (zlib.crc32(str(d).encode()) % 7 == 2) == out) for out in (True, False)]
    words = [f"w{i}" for i in range(40)]
    text = lambda: " ".join(rng.choice(words, 400))
    learned, asked = text(), text()
    tokens = ngrams.tokenised(spark.createDataFrame([(ids[0], asked), (ids[1], learned)], "doc_id long, text string").coalesce(1), 1_000_000)
    model = ngrams.train(tokens, 20)
    assert model.n_parts == 41 and model.parts.count() > 30
    got = np.frombuffer(b"".join(r.got for r in ngrams.answers(tokens, model).orderBy("part").collect() if r.kind == ngrams.PAIR_KEYS), np.uint8)
    pairs = lambda t: set(zip(t.split(), [*t.split()[1:], "end"], strict=True))
    seen = pairs(learned)
    assert len(got) == len(seen | pairs(asked)) and len(seen) <= (got > 0).sum() <= len(seen) + 0.05 * len(got)


def test_a_full_filter_ends():
    full = ngrams.LogBloom(np.full(1000, 255, np.uint8), 8000, 12)
    assert set(full.levels(np.arange(50, dtype=np.int64)).tolist()) == {12}


def test_a_score_with_an_exact_filter(spark):
    """Brute force: with so many bits that no probe errs, every score is the model's to rounding."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    rows = [tuple(r) for r in docs.collect()]
    want = plain_scores(rows)
    got = {r.doc_id: r.score for r in ngrams.score(spark.createDataFrame(rows, "doc_id long, text string"), 2_000, 2_000, bits_per_key=4_000).collect()}
    assert all(got[d] == pytest.approx(want[d], rel=1e-6) for d, _ in rows)
