"""Candidate selection: ever wider tiers until enough candidates are found.

Tiers: 1 district, type and venue; 2 region, type and venue; 3 type and venue; 4 region and type; 5 type; 6 all. A record belongs to
the first tier it matches. Without loops: the tier reached, the *base*, is the first whose running count is enough; the weights of
its years tell for which queries one year dominates, and for these alone wider tiers are looked at. Rows may be records, or
cells of equal records with their number n. ``tierindex`` finds the base without scoring anything; the functions here that
take all scored rows of a window (``select_v0``, ``gate_v1``, ``select_v1``) find it by their tiers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlens.functions.scoring import ENOUGH
from planlens.sources.staging import materialise

c = F.col
CAP, LOSS = 0.50, 0.05
#: Queries are broadcast to the records; more than this many at once are refused and belong in several calls.
MAX_QUERIES = 10_000


def tier(single_year: bool) -> Column:
    typed = F.arrays_overlap("q_types", "type_tokens")
    venue = c("q_venue") == c("venue_type")
    with_venue = F.lit(True) if single_year else c("q_venue").isNotNull()
    chain = F.when(with_venue & c("q_district").isNotNull() & typed & venue & (c("q_district") == c("district")), 1)
    chain = chain.when(with_venue & typed & venue & (c("q_region") == c("region")), 2).when(with_venue & typed & venue, 3)
    return chain.when(typed & (c("q_region") == c("region")), 4).when(typed, 5).otherwise(6)


def local(queries: DataFrame) -> DataFrame:
    """The queries as a relation of the driver's: they are what is asked, at most MAX_QUERIES, and every plan below holds them as they are."""
    if getattr(queries, "is_local", False):
        return queries
    found = queries.limit(MAX_QUERIES + 1).toArrow()
    if len(found) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries at once; split them in calls of at most {MAX_QUERIES}")
    out = queries.sparkSession.createDataFrame(found, queries.schema)
    out.is_local = True
    return out


def by_year(queries: DataFrame, first: int, last: int) -> DataFrame:
    """A row for each year of a query's window, as far as there are records."""
    return queries.where((c("first_year") <= last) & (c("last_year") >= first)).withColumn("dataset_year", F.explode(F.sequence(F.greatest("first_year", F.lit(first)), F.least("last_year", F.lit(last)))))


def pool(records: DataFrame, queries: DataFrame) -> DataFrame:
    """Every query with every record of its window, met by year; the queries are few and broadcast after their number is checked."""
    asked = local(queries)
    ends = records.agg(F.min("dataset_year").alias("a"), F.max("dataset_year").alias("z")).first()
    asked = by_year(asked, ends["a"], ends["z"]) if ends["a"] is not None else asked.where("false").withColumn("dataset_year", F.lit(0))
    return records.join(F.broadcast(asked), "dataset_year")


def usable(records: DataFrame) -> DataFrame:
    """Valid budgets, a region and at least one type."""
    return records.where("quality_flag = 'VALID' and region is not null and size(type_tokens) > 0")


def times(scored: DataFrame) -> Column:
    """How many records a scored row stands for: the n of a cell of equal records, or one."""
    return c("n") if "n" in scored.columns else F.lit(1).cast("long")


def summary(scored: DataFrame) -> DataFrame:
    """query_id, tier, dataset_year, n, w, best, written out: at most tiers x years rows for each query."""
    n = times(scored)
    return materialise(scored.groupBy("query_id", "tier", "dataset_year").agg(F.sum(n).alias("n"), F.sum(c("w") * n).alias("w"), F.max("sim").alias("best")), "tiers")


def _base(sums: DataFrame) -> DataFrame:
    counts = sums.groupBy("query_id", "tier").agg(F.sum("n").alias("n"))
    running = counts.withColumn("cum", F.sum("n").over(Window.partitionBy("query_id").orderBy("tier")))
    return running.groupBy("query_id").agg(F.coalesce(F.min(F.when(c("cum") >= ENOUGH, c("tier"))), F.lit(6)).alias("base_tier"), F.coalesce(F.min(F.when(c("cum") >= ENOUGH, c("cum"))), F.max("cum")).alias("base_count"))


def reached_v0(scored: DataFrame) -> DataFrame:
    """query_id, base_tier, base_count: the first tier whose running count is enough, or 6."""
    return _base(summary(scored))


def base_of(scored: DataFrame) -> DataFrame:
    """The scored rows of the base, with base_tier and base_count."""
    return scored.join(F.broadcast(local(reached_v0(scored))), "query_id").where("tier <= base_tier")


def chosen_v0(base: DataFrame) -> DataFrame:
    """The base with reached_tier, gate (never on) and the floor (none)."""
    return base.withColumn("reached_tier", c("base_tier")).withColumn("gate", F.lit(False)).withColumn("quality_floor", F.lit(None).cast("double"))


def select_v0(scored: DataFrame) -> DataFrame:
    """The selected candidates of all scored rows."""
    return chosen_v0(base_of(scored))


def gate(base: DataFrame, wider: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """query_id, base_tier, base_count, base_share, best, gate, quality_floor, reached_tier, reached_share; and the rows that the gate may let in.

    If one year holds more than half the weight of the base, wider tiers are added, but only records within LOSS of the best
    similarity, until no year does. A base share is a rounded quotient, so two equal years are exactly one half. ``wider``
    gives the scored rows beyond the base for queries with a gate, which are all that it is called with.
    """
    own = base.groupBy("query_id", "base_tier", "base_count", "dataset_year").agg(F.sum(c("w") * times(base)).alias("w"), F.max("sim").alias("best"))
    info = own.groupBy("query_id", "base_tier", "base_count").agg(F.max("best").alias("best"), F.round(F.max("w") / F.sum("w"), 12).alias("base_share"), F.collect_list(F.struct("dataset_year", "w")).alias("years"))
    on = (c("base_count") >= ENOUGH) & (c("base_share") > CAP)
    info = local(info.withColumn("gate", on).withColumn("quality_floor", F.when(on, F.round(c("best") - LOSS, 12))))
    gated = info.where("gate").select("query_id", "base_tier", "base_count", "quality_floor", "years")  # of a local relation, as all that is made of it here
    plain = info.where("not gate").drop("years").withColumn("reached_tier", c("base_tier")).withColumn("reached_share", c("base_share"))
    if not any(r["gate"] for r in info.select("gate").collect()):
        return plain, None
    more = materialise(wider(gated.drop("years")).where("tier > base_tier and sim >= quality_floor"), "wider")
    sums = more.groupBy("query_id", c("tier").alias("level"), "dataset_year").agg(F.sum(c("w") * times(more)).alias("w"))
    sums = sums.union(gated.select("query_id", c("base_tier").alias("level"), F.explode("years").alias("y")).select("query_id", "level", "y.dataset_year", "y.w"))
    levels = gated.select("query_id", F.explode(F.sequence("base_tier", F.lit(6))).alias("upto"))
    years = sums.join(F.broadcast(levels), "query_id").where("level <= upto").groupBy("query_id", "upto", "dataset_year").agg(F.sum("w").alias("w"))
    share = local(years.groupBy("query_id").agg(F.collect_list(F.struct("upto", "dataset_year", "w")).alias("y")))
    share = share.select("query_id", F.explode("y").alias("y")).groupBy("query_id", "y.upto").agg(F.round(F.max("y.w") / F.sum("y.w"), 12).alias("share"))
    solved = share.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("upto", "share"))).alias("shares"))
    found = info.where("gate").drop("years").join(solved, "query_id")
    lowest = F.array_min(F.filter(F.map_keys("shares"), lambda u: (u > c("base_tier")) & (F.element_at("shares", u) <= CAP)))
    found = found.withColumn("reached_tier", F.coalesce(lowest, F.lit(6))).withColumn("reached_share", F.element_at("shares", c("reached_tier"))).drop("shares")
    return plain.unionByName(found), more


def chosen_v1(base: DataFrame, wider: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The base, and for queries with a gate what it lets in from wider tiers."""
    gates, more = gate(base, wider)
    gates = F.broadcast(local(gates).drop("base_tier", "base_count"))
    found = base.join(gates, "query_id")
    if more is None:
        return found
    return found.unionByName(more.drop("quality_floor").join(gates, "query_id").where("tier <= reached_tier"))


def _within(scored: DataFrame) -> Callable[[DataFrame], DataFrame]:
    return lambda gated: scored.join(F.broadcast(gated), "query_id")


def gate_v1(scored: DataFrame) -> DataFrame:
    """The gate of each query over all scored rows."""
    return gate(base_of(scored), _within(scored))[0]


def select_v1(scored: DataFrame) -> DataFrame:
    return chosen_v1(base_of(scored), _within(scored))


def breakdown(chosen: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, tier, added, cumulative: what each tier up to the one reached brought, tiers that brought nothing included.

    Tier 1 applies to queries with a district, tiers 1 to 3 to those with a venue. ``chosen`` comes from ``select_v0`` or ``select_v1``.
    """
    applies = lambda t: ((t != 1) | c("q_district").isNotNull()) & ((t > 3) | c("q_venue").isNotNull())
    tiers = queries.select("query_id", F.explode(F.filter(F.sequence(F.lit(1), F.lit(6)), applies)).alias("tier"))
    counts = chosen.groupBy("query_id", "tier").agg(F.sum(times(chosen)).alias("added"), F.max("reached_tier").alias("reached"))
    reached = counts.groupBy("query_id").agg(F.max("reached").alias("reached"))
    listed = tiers.join(reached, "query_id", "left").where(c("tier") <= F.coalesce("reached", F.lit(6))).drop("reached").join(counts.drop("reached"), ["query_id", "tier"], "left")
    listed = listed.withColumn("added", F.coalesce("added", F.lit(0).cast("long")))
    return listed.withColumn("cumulative", F.sum("added").over(Window.partitionBy("query_id").orderBy("tier")))
