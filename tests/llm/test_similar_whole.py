"""Near copies at a similarity of 0.8: crowded stars, repeated shingles, short texts."""

import random
import re

import numpy as np
import pytest

from planlens.llm import simhash_similar


def classes(spark, rows):
    return {r.doc_id: r.component_id for r in simhash_similar.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_copies_of_one_base_that_are_unlike_one_another(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(204)]
    rows = [(1000, " ".join(base))]
    for d in range(300):
        w = list(base)
        for i in rng.sample(range(5, 199, 5), 4):
            w[i] = f"x{d}-{i}"
        rows.append((d, " ".join(w)))
    assert set(classes(spark, rows).values()) == {0}


def test_repeated_shingles(spark):
    spam = "spam " * 200
    words = [f"w{i}" for i in range(500)]
    rows = [(1, spam + " ".join(f"a{i}" for i in range(100))), (2, spam + " ".join(f"c{i}" for i in range(100))), (3, " ".join(words)), (4, " ".join(words + ["w499"] * 200))]
    assert classes(spark, rows) == {1: 1, 2: 2, 3: 3, 4: 3}


def test_short_texts(spark):
    """Four of five shingles in common, with no luck needed."""
    rows = []
    for d in range(200):
        w = [f"t{d}-{i}" for i in range(9)]
        rows += [(2 * d, " ".join(w[:8])), (2 * d + 1, " ".join(w))]
    got = classes(spark, rows)
    assert all(got[2 * d + 1] == 2 * d for d in range(200))


def brute_classes(rows):
    """Classes by comparing all pairs of shingle sets."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = [re.findall(r"[^\x20\x09-\x0D]+", low(t)) for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("block", [2, 512])
def test_against_brute_force_in_crowded_buckets(spark, block):
    """Long and short texts that share passages, a few of them similar; common passages fill buckets that are met in blocks."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for d in range(24):
        own = [f"o{d}-{i}" for i in range(rng.choice([0, 4, 12, 20, 900]))]
        rows.append((d, " ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :])))
    for d in range(24, 40):
        w = rows[rng.randrange(24)][1].split()
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"e{d}"
        rows.append((d, " ".join(w)))
    found = {r.doc_id: r.component_id for r in simhash_similar.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    want = brute_classes(rows)
    least = {}
    for (d, _), r in zip(rows, want):
        least[r] = min(least.get(r, d), d)
    assert found == {d: least[r] for (d, _), r in zip(rows, want)}


def test_maps_bound_what_sets_differ_by():
    rng = np.random.default_rng(1)
    for n in (0, 3, 255, 256, 257, 900, 5000):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        b = np.unique(np.concatenate([a[: n * 4 // 5], rng.integers(-(1 << 62), 1 << 62, n)]))
        x, y = (simhash_similar.parity_map(s, simhash_similar.wide_words(len(s))).view(np.uint64) for s in (a, b))
        assert 64 * len(x) >= 2 * len(a) and simhash_similar.differing(x, y) <= len(np.setxor1d(a, b))
        assert (simhash_similar.parity_map(a, 8) == simhash_similar.parity_map(a, 16)[:8] ^ simhash_similar.parity_map(a, 16)[8:]).all()


def test_one_row_of_each_class_stays_with_or_without_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text), (7, text + " x"), (3, text + " y"), (3, text + " y"), (3, "another text of the same id"), (None, "alone without an id"), (None, "alone without an id")]
    kept = simhash_similar.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(3, text + " y"), (3, "another text of the same id"), (None, "alone without an id")], key=str)


def test_simhash_links_are_made_and_confirmed(spark):
    """Pairs of fingerprints of at most two differing bits come from deletion variants; texts of one fingerprint meet the least of them."""
    nodes = spark.createDataFrame([(1, 0), (2, 0), (3, 3), (4, 7), (5, -1), (6, -1 - (1 << 40))], "node long, fp long")
    got = {(r.a, r.b) for r in simhash_similar.simhash_pairs(nodes).collect()}
    assert got == {(1, 2), (1, 3), (3, 4), (5, 6)}
    crowded = {(r.a, r.b) for r in simhash_similar.simhash_pairs(nodes, bucket=1).collect()}
    assert {(1, 2), (5, 6)} <= crowded and {n for p in crowded for n in p if n < 5} == {1, 2, 3, 4}
    docs = spark.createDataFrame([(1, " "), (2, None), (3, "a b c d e f"), (4, "A b c d e f"), (5, "g")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash_similar.similar_classes(docs).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)}
