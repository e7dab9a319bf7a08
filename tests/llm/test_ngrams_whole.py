"""Every pair counts, whatever the sizes of batches and parts."""

import math
from collections import Counter

import numpy as np
import pytest
from test_ngrams import held, tokens

from planlens.llm import ngrams


def quantised(k):
    return 0.0 if not k else 1.0 if k == 1 else 1.5 ** (math.floor(math.log(k) / math.log(1.5)) + 0.5)


def plain_scores(rows):
    c, pairs = Counter(), Counter()
    for d, x in rows:
        if not held(d):
            ts = tokens(x)
            c.update(ts)
            pairs.update(zip(ts, ts[1:]))
    div = sum(c.values()) + len(c) + 1

    def want(ts):
        out = math.log10((c[ts[0]] + 1) / div)
        for u, w in zip(ts, ts[1:]):
            trust = c[u] / (c[u] + ngrams.TRUST)
            out += math.log10(trust * (min(1.0, quantised(pairs[u, w]) / c[u]) if c[u] else 0) + (1 - trust) * (c[w] + 1) / div)
        return out

    return {d: want(tokens(x)) for d, x in rows}


@pytest.mark.parametrize("sizes", [(1_000_000, 1_000_000), (1, 100_000), (5_000, 2_000)])
def test_all_pairs_are_scored(spark, sizes):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = plain_scores(rows)
    got = {r.doc_id: r.score for r in ngrams.score(docs, *sizes).collect()}
    off = [abs(got[d] - want[d]) / len(tokens(x)) for d, x in rows]
    # only false positives of the filter differ
    assert np.mean(off) < 0.05 and np.median([o for o, (d, _) in zip(off, rows) if not held(d)]) < 0.02
