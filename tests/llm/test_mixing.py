"""Targets against a plain loop; taken words near them; no document over twice its size; reruns agree."""

import random
from collections import defaultdict

import numpy as np
import pytest

from planlens.llm import mixing


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        out |= {s: 2.0 * sizes[s] for s in over} if over else share
        open_ -= over or open_
    return out


@pytest.mark.parametrize("fan_in", [8192, 7])
def test_mix(spark, fan_in):
    rng = random.Random(fan_in)
    rows = [(i, rng.choices(["a", "b", "c", "d", None, "é"], [60, 20, 5, 2, 5, 3])[0], "w " * int(rng.paretovariate(0.9) * 3 % 400)) for i in range(900)]
    rows += [(None, "b", "x y"), rows[5], rows[5], (7000, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df, fan_in=fan_in).collect()
    assert len(got) == len(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.taken <= 2 * r.size
    want = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s]
    again = mixing.mix(df.repartition(5), fan_in=fan_in).collect()
    key = lambda rs: sorted((str(r.doc_id), r.size, r.taken) for r in rs)
    assert key(again) == key(got)


def test_pivot_keeps_expectations():
    size, p0 = np.array([5.0, 3.0, 8.0, 1.0]), np.array([0.3, 0.6, 0.5, 0.9])
    total = np.zeros(4)
    for i in range(4000):
        p = p0.copy()
        left = mixing.pivot(p, size, np.random.default_rng(i))
        assert p @ size == pytest.approx(p0 @ size)
        assert all(x in (0.0, 1.0) for j, x in enumerate(p) if j != left)
        total += p
    assert total / 4000 == pytest.approx(p0, abs=0.04)


def test_rows_equal_in_all_are_one_row_of_the_tree(spark, monkeypatch):
    """20,000 rows without an id and of one size: no group of the rounding holds more than one row of them, and the words come near the target."""
    docs = spark.range(20_000).selectExpr("cast(null as long) doc_id", "'a b c' text", "'s' source").union(spark.range(300).selectExpr("id doc_id", "'d e' text", "'t' source"))
    seen = []

    def watched(groups, function, schema, session, real=mixing.grouped):
        out = real(groups, function, schema, session)
        seen.append(out)
        return out

    monkeypatch.setattr(mixing, "grouped", watched)
    rows = mixing.mix(docs, fan_in=64).collect()
    assert len(rows) == 20_300
    assert max(r["n"] for r in seen[0].where("doc_id is null").groupBy("source", "chunk").count().withColumnRenamed("count", "n").collect()) == 1
    for source, target in {(r.source, r.target) for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in mine) - target) <= 3
        assert {r.copies for r in mine} <= {1, 2}
