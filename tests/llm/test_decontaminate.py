"""Distances and found items against plain dynamic programming."""

import math
import random
import re

from planlens.llm import decontaminate


def distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_myers():
    rng = random.Random(1)
    for _ in range(400):
        p, t = ("".join(rng.choices("abc", k=rng.randrange(n))) for n in (12, 30))
        k = rng.randrange(6)
        assert decontaminate.myers(p, t, k) == min(distance(p, t), k + 1)


def test_against_brute_force(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    items = [(i, text(rng.randrange(20, 90))) for i in range(25)] + [(90, None), (91, "short"), (92, "so Short?"), (93, " \n"), (3, "A" * 30)]
    docs = []
    for i in range(80):
        body = text(150)
        if i % 2:
            item = list(rng.choice(items[:25])[1])
            for _ in range(rng.randrange(6)):
                at = rng.randrange(len(item))
                item[at : at + rng.randrange(2)] = rng.choice(["", "x", "yz"])
            body = body[:70] + "".join(item).upper() + body[70:]
        docs.append((i, body))
    docs += [(200, None), (201, ""), (None, items[0][1]), docs[1], docs[1], (202, "ab short, cd"), (203, "shorter or too_short?"), (204, "shot so SHORT? yes"), (205, "so  short?"), (206, "so short!")]
    norm = decontaminate.normalised
    want = []
    for d, t in docs:
        for i, x in items:
            if x and 0 < len(norm(x)) < 24 and re.search(rf"(?<![^\W_]){re.escape(norm(x))}(?![^\W_])", norm(t)):
                want.append((d, i, 0))
            if x and len(norm(x)) >= 24 and (e := distance(norm(x), norm(t))) <= math.floor(0.08 * len(norm(x))):
                want.append((d, i, e))
    assert {(202, 91), (203, 91), (204, 91), (204, 92), (205, 92)} <= {(d, i) for d, i, _ in want}
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (4_000_000, 300):
        got = [tuple(r) for r in decontaminate.contaminated(df, bench, block_chars=block).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        bad = {d for d, _, _ in want}
        assert sorted(str(r.doc_id) for r in decontaminate.clean(df, bench, block_chars=block).collect()) == sorted(str(d) for d, _ in docs if d not in bad)
    assert decontaminate.contaminated(df.where("false"), bench).count() == 0
    assert decontaminate.clean(df, bench.where("false")).count() == len(docs)


def test_other_columns_give_way_or_stay(spark, odd_docs):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy", "x"), (2, "no id", "y")], "item_id long, text string, distance string")
    assert sorted(map(tuple, decontaminate.contaminated(odd_docs, items).collect()), key=str) == [(1, 1, 0), (1, 1, 0), (None, 2, 0)]
    assert sorted(r.doc_id for r in decontaminate.clean(odd_docs, items).collect()) == [2, 3, 4, 5, 6]
