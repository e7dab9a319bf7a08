"""The tier index against the same rules over every record of every window."""

import random

import pytest
from pyspark.sql import functions as F

from planlens.functions import scoring as S
from planlens.operators import estimate, planner, selection, tierindex
from planlens.operators.quantiles import exact_quantiles

RECORD = "id long, dataset_year int, region string, district string, type_tokens array<string>, venue_type string, duration_days int, budget_krw double, quality_flag string"
ASKED = "query_id int, q_region string, q_district string, q_types array<string>, q_venue string, q_duration int, first_year int, last_year int"


def tables(spark, seed, n, skewed=False):
    rng = random.Random(seed)
    pick = lambda xs: rng.choice(xs)
    years = [2001] * 9 + [2002, 2003] if skewed else [2001, 2002, 2003]
    rows = [
        (i, pick(years), pick(["A", "B", "C"]), pick(["a", "b", "c", "d", None]), rng.sample(["x", "y", "z", "w"], rng.randint(1, 2)), pick(["u", "v", S.UNDECIDED, None]), pick([1, 2, 3, 5, 0, None]), pick([0.0, -1.0, 1.0]) if i % 17 == 0 else rng.random() * 1e6, "VALID")
        for i in range(n)
    ]
    asked = []
    for q in range(60):
        first, last = sorted((pick([0, 2001, 2002]), pick([1999, 2001, 2002, 2003, 2010])))
        asked.append((q, pick(["A", "B", "Z"]), pick(["a", "b", "zz", None]), rng.sample(["x", "y", "q"], rng.randint(1, 2)), pick(["u", "v", S.UNDECIDED, None, "?"]), pick([1, 4, None]), first, last))
    return spark.createDataFrame(rows, RECORD), spark.createDataFrame(asked, ASKED)


def by_hand(rows, queries, select, single):
    """Everything scored, record by record."""
    every = tierindex.scores(selection.pool(rows, queries), single)
    same = every.where(F.arrays_overlap("q_types", "type_tokens") & (F.col("budget_krw") > 0)).select("query_id", F.ln("budget_krw").alias("log"))
    bounds = exact_quantiles(same, ["query_id"], "log", {"lo": 0.05, "hi": 0.95})
    chosen = (selection.select_v0 if select == "v0" else selection.select_v1)(every).where(F.col("sim") >= S.MIN_SIMILARITY)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "tier", "id"))
    return estimate.budgets(chosen.withColumn("rn", rank).where("rn <= 50"), bounds)


@pytest.mark.parametrize(("n", "select", "single", "skewed"), [(600, "v1", False, True), (600, "v0", True, False), (40, "v1", False, True), (0, "v1", False, False)])
def test_same_sample_as_scoring_everything(spark, n, select, single, skewed):
    rows, queries = tables(spark, n, n, skewed)
    index = tierindex.TierIndex.of(rows, lambda name, build: build(), single)
    fields = ["query_id", "rn", "id", "tier", "reached_tier", "gate"]
    shown = lambda df: sorted((*(r[f] for f in fields), round(r.sim, 9), round(r.value, 4)) for r in df.collect())
    got, want = shown(estimate.final_sample(index, queries, select)), shown(by_hand(rows, queries, select, single))
    assert got == want
    if n == 600 and skewed:
        assert any(r[5] for r in got)  # some gate is on


def test_a_request_scores_cells_of_its_own_keys_only(spark):
    """10,000 records in 200 windows' worth of cells: requests that reach tier 2 meet the cells of their region and venue, not the window."""
    rows = spark.range(10_000).selectExpr("id", "cast(2000 + id % 5 as int) dataset_year", "concat('R', id % 20) region", "concat('D', id % 200) district", "array(concat('T', id % 3)) type_tokens", "concat('V', id % 7) venue_type", "cast(id % 4 as int) duration_days", "1.0 * id budget_krw", "'VALID' quality_flag")
    queries = spark.createDataFrame([(q, f"R{q % 20}", None, ["T0"], f"V{q % 7}", 2, 0, 2010) for q in range(140)], ASKED)
    index = tierindex.TierIndex.of(rows, lambda name, build: build())
    counted = {r.query_id: (r.base_tier, r.base_count) for r in index.counted(queries).collect()}
    assert {t for t, _ in counted.values()} == {2}
    scored = index.base(queries).count()
    assert scored < 140 * 10_000 / 50
    assert index.base(queries).agg(F.sum("n")).first()[0] == sum(n for _, n in counted.values())


def test_trimmed_costs_with_an_outlier(spark):
    """One value of 10^12 times the others: the slices of the others stay as they are."""
    rng = random.Random(8)
    values = sorted([rng.uniform(1, 2) for _ in range(997)] + [1e12, 1e-9, 1.5])
    rows = spark.createDataFrame([(i, 1000.0, v * 1000) for i, v in enumerate(values)], "id int, visitors double, budget_krw double")
    got = planner.cost_summary(rows).first()
    left = values[50:950]
    q = lambda p: left[int(p * 899)] + (left[int(p * 899) + 1] - left[int(p * 899)]) * (p * 899 - int(p * 899))
    assert (got.n, got["median"], got.p25, got.p75) == (1000, int(q(0.5) + 0.5), int(q(0.25) + 0.5), int(q(0.75) + 0.5))
    empty = planner.cost_summary(rows.where("false")).first()
    assert (empty.n, empty["median"]) == (0, None)
