"""The base score against a plain count; the filter has no false negatives; the model beats the base on held-out texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from planlens.llm import ngrams


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text)) + [None]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


@pytest.mark.parametrize("sizes", [(1_000_000, 1_000_000), (3_000, 700)])
def test_against_plain_counts(spark, sizes):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(9001, None), (9002, ""), (None, "The the THE É é"), (9003, "never-seen-word-1 İ")], "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    c = Counter(t for d, x in rows if not held(d) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in ngrams.score(docs, *sizes).collect()}
    gain = 0.0
    for d, x in rows:
        r, ts = got[d], tokens(x)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d), len(ts), sum(c[t] > 0 for t in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), rel=1e-9)
        assert r.score <= 0
        gain += (r.score - r.base_score) if held(d) else 0.0
    assert gain > 0


def test_filter_has_no_false_negatives(spark):
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 1 << 62, 5000))
    counts = rng.zipf(1.5, len(pairs)).clip(1, 10**6)
    df = spark.createDataFrame([(int(p), int(k)) for p, k in zip(pairs, counts)], "pair long, c long")
    bloom = ngrams.build_filter(df)
    got = bloom.counts(pairs)
    want = np.array([1.0 if k == 1 else 1.5 ** (math.floor(math.log(k) / math.log(1.5)) + 0.5) for k in counts])
    assert (got >= want - 1e-9).all() and (np.isclose(got, want)).mean() > 0.95
    assert (bloom.counts(rng.integers(0, 1 << 62, 5000)) > 0).mean() < 0.05
