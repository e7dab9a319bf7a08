"""Min-max hashing against all pairs of full shingle sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from planlens.llm import minmax

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def expected(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)]


def corpus():
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghij") * rng.randrange(1, 4) + str(rng.randrange(60))
    base = [[word() for _ in range(rng.randrange(3, 200))] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base:  # from copies to texts just beside the limit
        for _ in range(4):
            c = list(b)
            for _ in range(rng.randrange(0, 1 + len(c) // 16)):
                c[rng.randrange(len(c))] = word()
            texts.append(" ".join(c))
    shared = [word() for _ in range(120)]
    texts += [" ".join(shared + [word() for _ in range(30 + 3 * i)]) for i in range(25)]  # one passage, not alike enough or just so
    texts += ["", None, " \t", "", "one", "ONE", "one two three", "one  two\tthree", "one two three four", "É é", "é É"]
    rows = list(enumerate(texts))
    return [*rows, (None, "no id here but words"), (None, "no id here but words"), (3, texts[3]), (3, texts[9]), (900, "no ID here but words of"), (None, "alone without an id at all")]


def test_classes_by_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("key", "node", "n", "root", "map", "bands", "txt", "kept")})
    got = [tuple(r) for r in minmax.near_duplicates(docs).collect()]
    want = [(d, n, c, d == c) for d, n, c, _ in expected(rows)]
    assert sorted(got, key=str) == sorted(want, key=str)
    small = [tuple(r) for r in minmax.near_duplicates(docs, block=8).collect()]  # crowded buckets, in many blocks
    assert sorted(small, key=str) == sorted(want, key=str)
    assert minmax.near_duplicates(docs.where("false")).count() == 0


def test_large_group_of_near_copies_stays_linear(spark):
    """2000 near copies of one text: the buckets hold all, and each meets the central one."""
    words = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(i, " ".join([*words, f"end{i}"])) for i in range(2000)], "doc_id long, text string")
    got = minmax.near_duplicates(docs).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.95])
def test_both_ends_estimate_the_similarity_without_bias(similarity):
    rng = np.random.default_rng(11)
    a, b = minmax.permutations(4000)
    n = 300
    both = round(similarity * n)
    union = rng.integers(0, 1 << 64, n, np.uint64)
    left, right = union[: both + (n - both) // 2], np.concatenate([union[:both], union[both + (n - both) // 2 :]])
    x, y = minmax.signatures([left, right], a, b)
    assert abs((x == y).mean() - both / n) < 0.03
    assert abs((x == y)[: len(a)].mean() - (x == y)[len(a) :].mean()) < 0.04
