"""Exact quantiles of groups of any size, without holding a group's values together.

Values fall into slices about a hundredth wide, by their logarithm. Counts per slice, which are combined before the shuffle,
tell in which slices the wanted ranks lie, and only the values of these slices are counted and sorted. Interpolation is linear
between the two ranks around p * (n - 1), as in ``percentile``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def slice_of(v: Column, per_octave: int = 64) -> Column:
    """An integer that never falls as ``v`` rises; no double is beyond 2 to the power of 1100 or nearer to zero than its inverse."""
    size = F.floor(F.log2(F.abs(v)) * per_octave).cast("int") + 1100 * per_octave
    return F.when(v == 0, 0).when(v > 0, size).otherwise(-size)


def place_of(p: float, n: Column, trim: Column) -> Column:
    """The rank from 0, with a fraction, of the quantile p among the n - 2 * trim values that are left when ``trim`` go at each end."""
    return trim + p * (n - 2 * trim - 1)


def wanted_slices(counts: DataFrame, by: list[str], ps: dict[str, float], trim: Callable[[Column], Column] = lambda n: 0 * n) -> DataFrame:
    """Of ``counts`` (by, slice, k) the slices that hold a wanted rank, with n (of the group) and before (in lower slices).

    ``trim`` tells how many values at each end don't count, from n.
    """
    group = Window.partitionBy(*by)
    counts = counts.withColumn("before", F.sum("k").over(group.orderBy("slice")) - c("k")).withColumn("n", F.sum("k").over(group))
    ranks = F.array(*(F.floor(place_of(p, c("n"), trim(c("n")))) + i for p in ps.values() for i in (0, 1)))
    return counts.where(F.exists(ranks, lambda r: (r >= c("before")) & (r < c("before") + c("k")))).drop("k")


def quantiles_of(values: DataFrame, by: list[str], ps: dict[str, float], trim: Callable[[Column], Column] = lambda n: 0 * n, number: Column | None = None) -> DataFrame:
    """The quantiles from the values v of the wanted slices, each with its group, slice, before and n; ``number`` adds up how often a value is there, if not once a row."""
    values = values.groupBy(*by, "slice", "before", "n", "v").agg((F.count("*") if number is None else number).alias("m"))
    last = c("before") + F.sum("m").over(Window.partitionBy(*by, "slice").orderBy("v")) - 1
    values = values.withColumn("last", last).withColumn("first", c("last") - c("m") + 1)
    out = []
    for name, p in ps.items():
        place = place_of(p, c("n"), trim(c("n")))
        low, high = (F.max(F.when((F.floor(place) + i).between(c("first"), c("last")), c("v"))) for i in (0, 1))
        part = F.max(place - F.floor(place))
        out.append(F.when((part == 0) | high.isNull(), low).otherwise((1 - part) * low + part * high).alias(name))
    return values.groupBy(*by).agg(F.max("n").alias("n"), *out)


def exact_quantiles(rows: DataFrame, by: list[str], value: str, ps: dict[str, float], trim: Callable[[Column], Column] = lambda n: 0 * n) -> DataFrame:
    """``by``, n, and a column for each name of ``ps``, of what ``trim`` leaves. Rows with a null value don't count; a group without any has no row."""
    sliced = rows.select(*by, c(value).cast("double").alias("v")).where("v is not null").withColumn("slice", slice_of(c("v")))
    counts = sliced.groupBy(*by, "slice").agg(F.count("*").alias("k"))
    return quantiles_of(sliced.join(wanted_slices(counts, by, ps, trim), [*by, "slice"]), by, ps, trim)
