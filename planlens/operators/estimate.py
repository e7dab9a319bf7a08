"""Budget estimation over the selected candidates, for many queries in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlens.functions import scoring as S
from planlens.operators import selection
from planlens.operators.tierindex import TierIndex
from planlens.sources.staging import materialise

c = F.col


def budgets(top: DataFrame, bounds: DataFrame) -> DataFrame:
    """The best records with adjusted budgets, and winsorised by ``bounds`` (query_id, lo, hi)."""
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    top = top.join(F.broadcast(bounds), "query_id", "left").withColumn("lo", F.coalesce("lo", low)).withColumn("hi", F.coalesce("hi", high))
    return top.withColumn("adjusted", S.adjusted_budget()).withColumn("value", S.winsorised_budget())


def final_sample(index: TierIndex, queries: DataFrame, select: str = "v1") -> DataFrame:
    """The best 50 selected candidates of each query that are similar enough, with adjusted and winsorised budgets; ``select``: v0 or v1."""
    chosen = chosen_cells(index, queries, select).where(c("sim") >= S.MIN_SIMILARITY)
    return budgets(index.best(chosen, S.MAX_SAMPLE), index.winsor(queries))


def chosen_cells(index: TierIndex, queries: DataFrame, select: str = "v1") -> DataFrame:
    base = materialise(index.base(queries), "base")
    return selection.chosen_v0(base) if select == "v0" else selection.chosen_v1(base, index.wider(queries))


def _hazen(sample: DataFrame, by: str) -> DataFrame:
    """Adds cf, the cumulated weight at the middle of each row, i, and the next row's value and cf as nv and ncf."""
    order = Window.partitionBy(by).orderBy("value", "rn")
    total = F.sum("w").over(Window.partitionBy(by))
    cum = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))
    df = sample.withColumn("cf", (cum - 0.5 * c("w")) / total)
    return df.withColumn("nv", F.lead("value").over(order)).withColumn("ncf", F.lead("cf").over(order)).withColumn("i", F.row_number().over(order))


def _hazen_quantiles(ps: tuple[float, ...]) -> list[Column]:
    outs = []
    for p in ps:
        between = c("value") + (c("nv") - c("value")) * F.when(c("ncf") > c("cf"), (p - c("cf")) / (c("ncf") - c("cf"))).otherwise(0.0)
        at = F.when((c("i") == 1) & (p <= c("cf")), c("value")).when(c("ncf").isNull() & (p >= c("cf")), c("value")).when((c("cf") <= p) & (p <= c("ncf")), between)
        outs.append(F.max(at).alias(f"p{round(p * 100)}"))
    return outs


def weighted_quantiles(sample: DataFrame, ps: tuple[float, ...], by: str = "query_id") -> DataFrame:
    """Weighted Hazen quantiles of ``value`` by ``w``: column p25 for 0.25 and so on; equal values in the order of ``rn``."""
    return _hazen(sample, by).groupBy(by).agg(*_hazen_quantiles(ps))


def core_stats(sample: DataFrame) -> DataFrame:
    """One row per query with a sample: means, quantiles, similarity, completeness, sample sizes, confidence and quality scores."""
    w, v = c("w"), c("value")
    local = F.when(c("q_district").isNotNull(), F.when(c("tier") == 1, 1.0).when(c("tier").isin(2, 4), 0.5).otherwise(0.0)).otherwise(F.when(c("tier").isin(2, 4), 1.0).otherwise(0.0))
    df = _hazen(sample, "query_id").groupBy("query_id").agg(
        *_hazen_quantiles((0.25, 0.5, 0.6, 0.75)),
        F.count("*").alias("sample_count"),
        (F.sum(v * w) / F.sum(w)).alias("weighted_average"),
        F.exp(F.sum(F.ln(v) * w) / F.sum(w)).alias("estimated"),
        (F.sum(c("sim") * w) / F.sum(w)).alias("similarity_avg"),
        (F.sum(F.when(c("duration_days").isNotNull(), w).otherwise(0.0)) / F.sum(w)).alias("completeness"),
        (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("ess"),
        (F.sum(local * w) / F.sum(w)).alias("local_evidence"),
        F.min("sim").alias("similarity_min"),
        F.min("dataset_year").alias("earliest_source_year"),
        F.max("dataset_year").alias("latest_source_year"),
        F.size(F.collect_set("dataset_year")).cast("long").alias("distinct_years"),
        F.first("reached_tier").alias("reached_tier"),
    )
    df = df.withColumn("confidence", S.confidence_v10(c("sample_count"), c("similarity_avg"), c("p25"), c("p50"), c("p75"), c("completeness")))
    df = df.withColumn("level", S.confidence_level(c("sample_count"), c("confidence")))
    df = df.withColumn("contingency_rate", 0.05 + (1 - c("confidence") / 100) * 0.10)
    df = df.withColumn("recommended", F.greatest("estimated", "p60") * (1 + c("contingency_rate")))
    return df.withColumn("data_quality", S.data_quality_v3(c("ess"), c("similarity_avg"), c("p25"), c("p75"), c("completeness"), c("local_evidence")))


def year_breakdown(sample: DataFrame) -> DataFrame:
    """query_id, dataset_year, n, share: each year's part of the sample's weight."""
    years = sample.groupBy("query_id", "dataset_year").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    return years.select("query_id", "dataset_year", "n", (c("w") / F.sum("w").over(Window.partitionBy("query_id"))).alias("share"))


def effective_years(sample: DataFrame) -> DataFrame:
    """The inverse Simpson number of years and the share of the latest one."""
    years = year_breakdown(sample)
    return years.groupBy("query_id").agg((1 / F.sum(c("share") * c("share"))).alias("effective_years"), F.max("share").alias("max_year_share"), F.max_by("share", "dataset_year").alias("latest_year_share"))


def scope_breakdown(sample: DataFrame) -> DataFrame:
    """query_id, tier, pct, ord: the weight of each tier in the sample in per cent, in the order they first appear."""
    per = sample.groupBy("query_id", "tier").agg(F.sum("w").alias("w"), F.min("rn").alias("first"))
    window = Window.partitionBy("query_id")
    return per.select("query_id", "tier", (100 * c("w") / F.sum("w").over(window)).alias("pct"), F.row_number().over(window.orderBy("first")).alias("ord"))


def breakdown_text(sample: DataFrame) -> DataFrame:
    """query_id, breakdown: year:count:share of each year of the sample, in order, joined by bars."""
    part = F.format_string("%d:%d:%.6f", c("dataset_year"), c("n"), c("share"))
    return year_breakdown(sample).groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list(part)), "|").alias("breakdown"))


def parsed_breakdown(rows: DataFrame) -> DataFrame:
    """The rows of ``year_breakdown`` read back from ``breakdown_text``; an empty text has none."""
    part = rows.where("breakdown <> ''").select("query_id", F.explode(F.split("breakdown", r"\|")).alias("p")).withColumn("p", F.split("p", ":"))
    return part.select("query_id", F.get("p", F.lit(0)).try_cast("int").alias("dataset_year"), F.get("p", F.lit(1)).try_cast("long").alias("n"), F.get("p", F.lit(2)).try_cast("double").alias("share"))


def planning_result(sample: DataFrame, queries: DataFrame, years: DataFrame) -> DataFrame:
    """One row per query with all that a plan is told: policies, window, pool, statistics, years and the ids of the best ten.

    ``years`` (query_id, pool_earliest, pool_latest) is of all records of the window. The window ends where the policy says, not
    where the data ends; without data it begins at the planning year. A query without a sample has zeros and nulls.
    """
    best = sample.where("rn <= 10").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"].cast("string")), ",").alias("top_ids"))
    out = queries.join(core_stats(sample), "query_id", "left").join(effective_years(sample), "query_id", "left").join(breakdown_text(sample), "query_id", "left").join(best, "query_id", "left").join(years, "query_id", "left")
    zero = lambda n, digits: F.coalesce(F.round(n, digits), F.lit(0.0)).alias(n)
    return out.select(
        "query_id", c("q_planning_year").alias("planning_year"), c("q_policy").alias("requested_policy"), "applied_policy", F.coalesce("pool_earliest", "q_planning_year").alias("year_from"), c("last_year").alias("year_to"), "pool_earliest", "pool_latest",
        F.coalesce("sample_count", F.lit(0).cast("long")).alias("sample_count"), F.coalesce("distinct_years", F.lit(0).cast("long")).alias("distinct_years"), "earliest_source_year", "latest_source_year", zero("effective_years", 6), zero("ess", 4), zero("similarity_avg", 6), zero("data_quality", 4),
        *(F.coalesce(S.half_up(c(n)), F.lit(0).cast("long")).alias(n) for n in ("estimated", "weighted_average", "recommended", "p25", "p50", "p60", "p75")), F.coalesce("reached_tier", F.lit(0)).alias("reached_tier"), F.coalesce("breakdown", F.lit("")).alias("breakdown"), F.coalesce("top_ids", F.lit("")).alias("top_ids"),
    )
