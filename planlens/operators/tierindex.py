"""An index of records for many requests: each reads the few cells that it needs, not all records of its window.

Records that agree in year, region, district, types, venue and duration are one *cell* with their number, as every request
finds them equally similar. Three tables are made of the records once:

* ``cells``: the cells;
* ``levels``: their numbers by the keys of each tier (district and venue, region and venue, venue, region, types, all), from one pass
  of grouping sets. A request meets the rows of its own keys by equality, and running counts by inclusion and exclusion tell
  the tier that it reaches, before anything is scored;
* ``slices``: numbers of budgets by types, year and slice of the value range, from which the ranks of winsor bounds are placed.

A request that reaches tier t scores the cells of tiers up to t, met by equality on the keys of that tier; one with the gate on
scores the others of its window as well. Of the chosen cells only those that can hold one of the best 50 records, by running
numbers in order of similarity, are looked up in the records.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from planlens.functions import scoring as S
from planlens.operators import selection
from planlens.operators.quantiles import quantiles_of, slice_of, wanted_slices

c = F.col
CELL = ("dataset_year", "region", "district", "type_tokens", "venue_type", "duration_days")
#: The keys of each level; a request and a level's row meet where the keys, which it has all of, are equal.
LEVELS = {"drv": ("district", "region", "venue_type"), "dv": ("district", "venue_type"), "rv": ("region", "venue_type"), "v": ("venue_type",), "r": ("region",), "t": (), "a": ()}
KEYS = ("district", "region", "venue_type")
ASKED = {"district": "q_district", "region": "q_region", "venue_type": "q_venue"}


def _cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*CELL).agg(F.count("*").alias("n"))


def _levels(cells: DataFrame) -> DataFrame:
    """kind, district, region, venue_type (empty where the level has no such key), dataset_year, type_tokens, n."""
    columns = (*KEYS, "type_tokens", "dataset_year")
    sets = {kind: [*keys, *(["type_tokens"] if kind != "a" else []), "dataset_year"] for kind, keys in LEVELS.items()}
    # the grouping id has a bit for each column, the first one highest, set if the column is not in the set
    ids = {sum(1 << (len(columns) - 1 - i) for i, n in enumerate(columns) if n not in names): kind for kind, names in sets.items()}
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in ids.items() for x in pair)), c("g").cast("int"))
    found = cells.groupingSets(list(sets.values()), *columns).agg(F.sum("n").alias("n"), F.grouping_id().alias("g")).withColumn("kind", kind)
    has = {n: c("kind").isin(*(k for k, keys in LEVELS.items() if n in keys)) for n in KEYS}
    for n in KEYS:  # a record without a district or venue is under no key of it
        found = found.where(~has[n] | c(n).isNotNull())
    return found.select("kind", *(F.when(has[n], c(n)).otherwise("").alias(n) for n in KEYS), "dataset_year", "type_tokens", "n")


def _slices(rows: DataFrame) -> DataFrame:
    return logs(rows).groupBy("type_tokens", "dataset_year", "slice").agg(F.count("*").alias("k"))


def logs(rows: DataFrame) -> DataFrame:
    """type_tokens, dataset_year, v (the log of the budget) and its slice, of records with a budget."""
    found = rows.where("budget_krw > 0").select("type_tokens", "dataset_year", F.ln("budget_krw").alias("v"))
    return found.withColumn("slice", slice_of(c("v")))


def scores(met: DataFrame, single_year: bool) -> DataFrame:
    """Adds tier, sim and w = sim squared to rows of records or cells beside a request."""
    sim = S.single_year_similarity() if single_year else S.multi_year_similarity()
    return met.withColumn("tier", selection.tier(single_year)).withColumn("sim", sim).withColumn("w", c("sim") * c("sim"))


@dataclass
class TierIndex:
    rows: DataFrame
    cells: DataFrame
    levels: DataFrame
    slices: DataFrame
    years: tuple[int, int]
    single_year: bool

    @classmethod
    def of(cls, rows: DataFrame, stage: Callable[[str, Callable[[], DataFrame]], DataFrame], single_year: bool = False) -> TierIndex:
        """``rows`` are usable records; ``stage`` writes a table out, or gives the one that is there."""
        cells = stage("cells", lambda: _cells(rows))
        if not hasattr(cells, "years"):  # a stage is one object for all who ask for it
            ends = cells.agg(F.min("dataset_year"), F.max("dataset_year")).first()
            cells.years = (ends[0], ends[1]) if ends[0] is not None else (1, 0)
        return cls(rows, cells, stage("levels", lambda: _levels(cells)), stage("slices", lambda: _slices(rows)), cells.years, single_year)

    def scored(self, queries: DataFrame) -> DataFrame:
        """All cells of the windows, for results that are about all of them."""
        return scores(self.cells.join(F.broadcast(selection.by_year(selection.local(queries), *self.years)), "dataset_year"), self.single_year)

    def counted(self, queries: DataFrame) -> DataFrame:
        """The queries with base_tier and base_count, by the levels alone; those without any record in their window are not there."""
        asks = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), *((c(ASKED[n]) if n in keys else F.lit("")).alias(n) for n in KEYS)) for kind, keys in LEVELS.items()))).alias("a")
        asked = queries.select("query_id", "q_types", "first_year", "last_year", asks).select("query_id", "q_types", "first_year", "last_year", "a.*")
        met = self.levels.join(F.broadcast(asked), ["kind", *KEYS]).where(c("dataset_year").between(c("first_year"), c("last_year")))
        met = met.where((c("kind") == "a") | F.arrays_overlap("q_types", "type_tokens"))
        one = lambda kind: F.coalesce(F.sum(F.when(c("kind") == kind, c("n"))), F.lit(0)).alias(kind)
        counts = met.groupBy("query_id").agg(*map(one, LEVELS))
        # running counts: tiers 1 and 2 share the records of district and region, tiers 3 and 4 those of region and venue
        running = F.array(c("dv"), c("dv") + c("rv") - c("drv"), c("v"), c("v") + c("r") - c("rv"), c("t"), c("a"))
        place = F.array_position(F.transform(running, lambda n: n >= selection.ENOUGH), True)
        tier = F.when(place > 0, place).otherwise(6).cast("int")
        counts = counts.where("a > 0").withColumn("base_tier", tier).withColumn("base_count", F.element_at(running, tier)).select("query_id", "base_tier", "base_count")
        return selection.local(queries.join(F.broadcast(counts), "query_id"))

    def base(self, queries: DataFrame) -> DataFrame:
        """The scored cells of the base of each query, with base_tier and base_count: cells are met by the keys of the tier reached."""
        counted = self.counted(selection.local(queries))
        asked = selection.by_year(counted, *self.years)
        here, other = c("region") == c("q_region"), ~c("region").eqNullSafe(c("q_region"))
        everything = F.lit(True)
        ways: list[tuple[str, tuple[str, ...], Column]] = [
            ("base_tier = 1", ("district", "venue_type"), everything),
            ("base_tier = 2", ("district", "venue_type"), other),  # those of the region come by the next one
            ("base_tier = 2", ("region", "venue_type"), here),
            ("base_tier = 3", ("venue_type",), everything),
            ("base_tier = 4", ("venue_type",), other),
            ("base_tier = 4", ("region",), here),
            ("base_tier in (5, 6)", (), everything),
        ]
        reached = {r["base_tier"] for r in counted.select("base_tier").collect()}
        found = None
        for which, keys, also in ways:
            if not reached & ({5, 6} if "in" in which else {int(which[-1])}):
                continue
            side = asked.where(which)
            same = [self.cells["dataset_year"] == side["dataset_year"], *(self.cells[k] == side[ASKED[k]] for k in keys)]
            met = self.cells.join(F.broadcast(side), same).drop(side["dataset_year"]).where(also)
            met = scores(met, self.single_year).where("tier <= base_tier")
            found = met if found is None else found.unionByName(met)
        if found is None:
            return scores(self.cells.join(F.broadcast(asked), "dataset_year"), self.single_year)
        return found

    def wider(self, queries: DataFrame) -> Callable[[DataFrame], DataFrame]:
        """For ``selection.gate``: the scored cells of the windows of queries with a gate."""
        return lambda gated: self.scored(queries.join(gated.select("query_id"), "query_id", "left_semi")).join(F.broadcast(gated), "query_id")

    def winsor(self, queries: DataFrame) -> DataFrame:
        """query_id, lo, hi: the 5 % and 95 % quantiles of the log budgets of all records of the window with a type of the query.

        Queries with the same types and years share theirs; only values of slices that hold a wanted rank are read again.
        """
        asked = selection.local(queries)
        keys = sorted({(tuple(r["q_types"]), r["first_year"], r["last_year"]) for r in asked.collect()})
        number = {k: i for i, k in enumerate(keys)}
        spark = queries.sparkSession
        every = selection.by_year(spark.createDataFrame(pa.table({"sought": pa.array(range(len(keys)), pa.int32()), "q_types": pa.array([list(k[0]) for k in keys], pa.list_(pa.string())), "first_year": pa.array([k[1] for k in keys], pa.int32()), "last_year": pa.array([k[2] for k in keys], pa.int32())})), *self.years)
        ps = {"lo": 0.05, "hi": 0.95}
        counts = self.slices.join(F.broadcast(every), "dataset_year").where(F.arrays_overlap("q_types", "type_tokens")).groupBy("sought", "slice").agg(F.sum("k").alias("k"))
        wanted = wanted_slices(counts, ["sought"], ps).join(F.broadcast(every), "sought")
        values = logs(self.rows).join(F.broadcast(wanted), ["dataset_year", "slice"]).where(F.arrays_overlap("q_types", "type_tokens"))
        found = quantiles_of(values.select("sought", "slice", "before", "n", "v"), ["sought"], ps)
        bounds = {r["sought"]: (r["lo"], r["hi"]) for r in found.collect()}
        rows = [(r["query_id"], *bounds[i]) for r in asked.collect() if (i := number[tuple(r["q_types"]), r["first_year"], r["last_year"]]) in bounds]
        ids, lo, hi = zip(*rows, strict=True) if rows else ((), (), ())
        kind = pa.int64() if asked.schema["query_id"].dataType == LongType() else pa.int32()
        return spark.createDataFrame(pa.table({"query_id": pa.array(ids, kind), "lo": pa.array(lo, pa.float64()), "hi": pa.array(hi, pa.float64())}))

    def best(self, chosen: DataFrame, n: int) -> DataFrame:
        """The ``n`` best records of each query among the chosen cells, by similarity, tier and id, with rn."""
        steps = chosen.groupBy("query_id", "sim", "tier").agg(F.sum("n").alias("k"))
        order = Window.partitionBy("query_id").orderBy(c("sim").desc(), "tier")
        steps = steps.withColumn("before", F.sum("k").over(order) - c("k")).where(c("before") < n).select("query_id", "sim", "tier")
        cells = chosen.drop("n").join(steps, ["query_id", "sim", "tier"], "left_semi")
        rows = self.rows.select("id", "budget_krw", *(c(x).alias(f"r_{x}") for x in CELL))
        met = rows.join(cells, [c(f"r_{x}").eqNullSafe(c(x)) for x in CELL]).drop(*(f"r_{x}" for x in CELL))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(c("sim").desc(), "tier", "id"))
        return met.withColumn("rn", rank).where(c("rn") <= n)
