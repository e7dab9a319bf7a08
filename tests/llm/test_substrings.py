"""Removed words against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from planlens.llm import substrings


def brute(rows, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 7])
def test_planted_repeats(spark, parts):
    rng = random.Random(parts)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 9)
    shared = [[word() for _ in range(n)] for n in (11, 12, 13, 40)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(40))]
        for s in rng.sample(shared, rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = s
        rows.append((i, " ".join(w)))
    rows += [(100, "x " * 30), (101, "p q " * 20), (102, None), (103, ""), (None, "a b c"), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert sorted((tuple(r) for r in substrings.remove_repeats(df, 12).collect()), key=str) == brute(rows, 12)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = sorted((tuple(r) for r in substrings.remove_repeats(docs).collect()), key=str)
    assert got == brute([tuple(r) for r in docs.collect()], 35)
