"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component.

    Every step is a minimum per node, combined before the shuffle, and an equality join; a node with very many
    neighbours is a skewed join key that adaptive execution splits. Joins are by merge, so that the driver holds no table of nodes,
    as it would for a broadcast. Each round is written to the shared folder.
    Rows with a null or equal ends are ignored. Raises if the steps have not settled after ``rounds`` rounds.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialise(e, "edges")
    before = _state(e)
    for _ in range(rounds):
        if not before[0]:
            break
        # large star: every neighbour above a node is tied to the least of the node and its neighbours
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its lower neighbours are tied to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(low.hint("merge"), "a")
        small = tied.select(F.col("b").alias("x"), "m").union(tied.select(F.col("a").alias("x"), "m"))
        old, e = e, materialise(small.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        discard(old)
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
