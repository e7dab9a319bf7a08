"""Exact search against brute force, with ties, repeated rows and vectors that take no part."""

import math
import random

import numpy as np
import pytest

from planlens.llm import topk


def brute(rows, k, every):
    fine = [(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in set(fine):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in fine if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard,block,sample", [(8192, 2048, 2048), (16, 3, 8), (16, 3, 1024)])
def test_against_brute_force(spark, shard, block, sample):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(6)]) for i in range(300)]
    rows += [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300, 500)] + rows[:40]
    rows += [(10, [0.25] * 6), (11, [0.5] * 6), (11, [0.25] * 5)]  # an id with two vectors, and a shorter one
    rows += [(None, [1.0] * 6), (900, None), (901, [None] * 6), (902, [math.inf] * 6), (950, [math.nan] * 6)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10, shard=shard, block=block, sample=sample)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 10)


def test_equal_rows_are_candidates_each(spark):
    """A candidate that occurs twice takes two places; the query's own rows take none."""
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert [(r.query_id, r.rank, r.vec_id) for r in got.orderBy("rank").collect()] == [(50, 1, 7), (50, 2, 7), (50, 3, 8)]


def test_far_shards_are_not_visited(spark):
    """Two far clusters: a query's kth score from its own shard rules the other one out."""
    rng = random.Random(2)
    rows = [(i, [(40.0 if i % 2 else -40.0) + rng.random(), rng.random()]) for i in range(400)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    cells = topk.Cells.of(np.array([r.v for r in vectors.collect()], np.int64), 1)
    placed = topk.dealt(vectors, cells, 2, 1000)
    grown = topk.trees(placed, 2)
    asks = placed.where("vec_id % 50 = 0").selectExpr("vec_id query_id", "vec_id ask", "v", f"{topk.LOWEST} floor", "shard")
    assert topk.reachable(asks, grown, 2, 1).count() == 8
    assert topk.reachable(asks.withColumn("floor", asks.floor * 0), grown, 2, 1).count() == 0


def test_few_and_no_candidates(spark):
    schema = "vec_id long, embedding array<float>, score string, rank string"
    two = spark.createDataFrame([(0, [1.0], "x", "y"), (7, [2.0], "x", "y")], schema)
    assert [tuple(r) for r in topk.top_k(two).collect()] == [(0, 1, 7, 256 * 512)]
    assert topk.top_k(two.where("false")).count() == 0
    assert topk.top_k(two.where("vec_id = 0")).count() == 0


def test_components_whose_products_overflow_are_refused(spark):
    fine = spark.createDataFrame([(0, [1e6, -1e6]), (1, [1e6, 1e6])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(fine).collect()] == [(0, 1, 1, 0)]
    for x in (1e300, 1e17):
        with pytest.raises(Exception, match="do not fit"):
            topk.top_k(spark.createDataFrame([(0, [x, 1.0]), (1, [1.0, x])], "vec_id long, embedding array<double>")).collect()
