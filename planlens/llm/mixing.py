"""Mixing sources to target weights by pivotal dependent rounding.

A source that should give T words and holds S has the copy rate r = T / S (at most ``most``). Every document gets
floor(r) copies for certain and one more with probability r - floor(r). Independent draws would miss the target, so the
fractional probabilities are rounded dependently: two documents are paired and probability mass, counted in words, moves
from one to the other at random (each keeps its expectation) until one of them is 0 or 1. The words of a source are
preserved by every move, so that it ends within one document of its target (large ones are paired first, so that mostly
a small one is left).

The pairs form a reduction tree: documents are dealt by hash into chunks of about ``fan_in`` per source and resolved in
there but for one residual; the residuals are dealt into chunks of ``fan_in`` again, up to one per source, which a last
draw rounds. A source with a third of all rows is so many chunks more, never one group. Draws are seeded by the chunk's
name and rows are sorted, so reruns agree.

Rows equal in doc_id, source and size (all those without an id, say) are one row with their number m: m * p rounded down of
them get one copy more for certain, and only the fraction left takes part in the tree. They are numbered by counts per input
partition, so no task holds them together.

Defined cases: a null text has size 0; a document of size 0 takes 0 words; null is a source of its own, the last in order;
rows repeated in all columns are separate documents (which of the equal rows is taken more often is immaterial);
an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, grouped, materialise

WEIGHTS = (5, 2, 1)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size, the number of words of the whole text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, n, source_size, target: one row per source.

    The capped shares are min(most * size, level * weight) for the one level at which they add up to the total; sorted
    by size / weight, the sources below the level are a prefix, so running sums give it. One row per source is sorted.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", weight.cast("double")).withColumn("cap", most * F.col("source_size").cast("double")).withColumn("turn", F.col("cap") / F.col("w"))
    up, everything = Window.orderBy("turn", F.col("source").asc_nulls_last()), Window.partitionBy()
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    per = per.withColumn("level", rest / left)
    # the first source (in this order) that is not capped sets the level of all after it; without one all are capped
    level = F.min(F.when(F.col("level") <= F.col("turn"), F.struct("turn", "level"))).over(everything)["level"]
    per = per.withColumn("level", level)
    return per.select("source", "n", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w"))).alias("target"))


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> int:
    """Round ``p`` in place by pairwise moves that keep sum(p * size); return the index left fractional, or -1."""
    held = -1
    for i in range(len(p)):
        if p[i] <= 0 or p[i] >= 1:
            continue
        if held < 0:
            held = i
            continue
        a, b, wa, wb = p[held], p[i], size[held], size[i]
        up = min((1 - a) * wa, b * wb)  # words that may move to the held one
        down = min(a * wa, (1 - b) * wb)
        if rng.random() * (up + down) < down:  # the move up has probability down / (up + down): no expected change
            a, b = (1.0, b - up / wb) if up == (1 - a) * wa else (a + up / wa, 0.0)
        else:
            a, b = (0.0, b + down / wb) if down == a * wa else (a - down / wa, 1.0)
        a, b = (round(x) if abs(x - round(x)) < 1e-12 else x for x in (a, b))
        p[held], p[i] = a, b
        if a in (0, 1):
            held = i if 0 < b < 1 else -1
    return held


LEVEL = "doc_id long, source string, size long, source_size long, target double, copies long, sure long, m long, p double, chunk long, n_chunks long, extra int"


def _resolve(level: int, seed: int):
    def chunk(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["size", "doc_id", "p"], ascending=[False, True, True], na_position="last", kind="stable").reset_index(drop=True)
        name = f"{seed}:{level}:{df['source'].iloc[0]}:{df['chunk'].iloc[0]}"
        p = df["p"].to_numpy(float, copy=True)
        rng = np.random.default_rng(xxhash.xxh64_intdigest(name))
        held = pivot(p, df["size"].to_numpy(float), rng)
        df["p"] = p
        extra = np.where(p >= 1, 1, 0)
        if held >= 0:
            extra[held] = int(rng.random() < p[held]) if df["n_chunks"].iloc[0] == 1 else -1
        df["extra"] = extra.astype("int32")
        return df

    return chunk


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, fan_in: int = 8192, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target (of its source), copies and taken, the words the mix takes of the document."""
    sizes = materialise(sized(docs).withColumn("part", F.spark_partition_id()), "sizes")
    goal = materialise(targets(sizes, weights, share, most), "targets")
    runs = sizes.groupBy("doc_id", "source", "size", "part").agg(F.count("*").alias("c"))
    equal = Window.partitionBy("doc_id", "source", "size")
    before = F.sum("c").over(equal.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("m", F.sum("c").over(equal)).withColumn("first", F.coalesce(before, F.lit(0)))
    joined = runs.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(0.0)
    joined = joined.withColumn("copies", F.floor(rate)).withColumn("mass", F.col("m") * (rate - F.floor(rate)))
    joined = materialise(joined.withColumn("sure", F.floor("mass")).withColumn("p", F.col("mass") - F.floor("mass")).drop("mass", "part"), "runs")
    open_ = joined.where("p > 0 and first = 0").withColumn("n_chunks", F.ceil(F.col("n") / fan_in))
    open_ = open_.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.col("n_chunks")))
    done, level = [], 0
    deepest = goal.agg(F.max("n")).first()[0] or 0
    while True:
        rows = open_.selectExpr("doc_id", "source", "size", "source_size", "target", "copies", "sure", "m", "p", "chunk", "n_chunks", "0 extra")
        out = materialise(grouped(rows.groupBy("source", "chunk"), _resolve(level, seed), LEVEL, docs.sparkSession), "level")
        done.append(out.where("extra >= 0").selectExpr("doc_id", "source", "size", "source_size", "target", "copies", "sure + extra as more", "m"))
        level, deepest = level + 1, -(-deepest // fan_in)
        if deepest <= 1:
            break
        open_ = out.where("extra < 0").withColumn("n_chunks", F.ceil(F.col("n_chunks") / fan_in)).withColumn("chunk", F.floor(F.col("chunk") / fan_in))
    rounded = reduce(DataFrame.unionByName, done)
    # a row that has no equal is its own result; the others get theirs by number
    lone = rounded.where("m = 1").withColumn("copies", F.col("copies") + F.col("more"))
    fixed = joined.where("p = 0").withColumn("more", F.col("sure"))
    drawn = rounded.where("m > 1").selectExpr("doc_id as d", "source as s", "size as z", "more")
    several = joined.where("p > 0 and m > 1").join(drawn, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    several = several.select(*fixed.columns).union(fixed).withColumn("i", F.explode(F.sequence("first", F.col("first") + F.col("c") - 1)))
    several = several.withColumn("copies", F.col("copies") + (F.col("i") < F.col("more")).cast("long"))
    columns = ["doc_id", "source", "size", "source_size", "target", F.col("copies").cast("int").alias("copies")]
    every = lone.select(*columns).union(several.select(*columns))
    return every.withColumn("taken", F.col("copies") * F.col("size"))
