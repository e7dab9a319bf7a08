"""The queries of the library's own operators, each with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planlens.functions import scoring as S
from planlens.operators import estimate, parity, planner, policy, selection
from planlens.operators.tierindex import TierIndex
from planlens.plans import requests
from planlens.sources import ingest
from planlens.sources.records import COLUMNS, FEATURES, LATEST_SQL, RECORDS_SQL, records, table
from planlens.sources.staging import materialise, staged

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- estimation: the same rules once more, as SQL for DuckDB


SOURCES = ("orders", "customer", "nation", "region", "lineitem", "part")


def _stored(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = FEATURES, only_latest: bool = False) -> DataFrame:
    """The records with the columns in use, written out once for all queries, as an estimate looks at them several times."""
    made_with = f"{','.join(columns)} {only_latest}"
    return staged(spark, "records", [f"{sf_dir}/{t}.parquet" for t in SOURCES], made_with, lambda: records(spark, sf_dir, columns, only_latest))


def _queries(spark: SparkSession, rows: DataFrame | None = None) -> DataFrame:
    """The multi-year requests, or with ``rows``, the records of the latest year, the single-year ones; that year is the latest of all records, usable or not."""
    if rows is None:
        return policy.resolve(requests.frame(spark, requests.MULTI), policy.status_table(spark)).withColumn("first_year", F.lit(0))
    year = rows.agg(F.max("dataset_year").alias("y"))
    return requests.frame(spark, requests.SINGLE).crossJoin(year).withColumn("first_year", c("y")).withColumn("last_year", c("y")).drop("y")


def _index(spark: SparkSession, sf_dir: str, single: bool = False) -> tuple[TierIndex, DataFrame]:
    """The index of the usable records, shared by all queries of the session, and the requests."""
    if single:
        rows = _stored(spark, sf_dir, tuple("festival_type" if n == "type_tokens" else n for n in FEATURES), True)
        usable, queries = selection.usable(rows.withColumn("type_tokens", F.array("festival_type"))), _queries(spark, rows)
    else:
        usable, queries = selection.usable(_stored(spark, sf_dir)), _queries(spark)
    inputs = [f"{sf_dir}/{t}.parquet" for t in SOURCES]
    return TierIndex.of(usable, lambda name, build: staged(spark, name, inputs, f"single {single}", build), single), selection.local(queries)


def _scored(spark: SparkSession, sf_dir: str, single: bool = False) -> DataFrame:
    """All cells of each request's window."""
    index, queries = _index(spark, sf_dir, single)
    return index.scored(queries)


def _sample(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    index, queries = _index(spark, sf_dir, kind == "single")
    return estimate.final_sample(index, queries, "v1" if kind == "v1" else "v0")


def _sql(kind: str, tail: str, asked: str | None = None) -> str:
    """The chain from records to statistics for ``kind`` single, v0 or v1; ``tail`` selects from it. ``asked``: SQL of the requests q0, if not the sample ones."""
    single = kind == "single"
    ok = "quality_flag = 'VALID' and region is not null and len(type_tokens) > 0"
    if single:
        qs = requests.sql(requests.SINGLE) + ", q as (select q0.*, y first_year, y last_year from q0, (select max(dataset_year) y from records))"
        r = f"r as (select * replace ([festival_type] as type_tokens) from records where quality_flag = 'VALID' and region is not null)"
    else:
        qs = (asked or requests.sql(requests.MULTI)) + """, q as (select *, 0 first_year, q_planning_year - case when q_policy = 'INCLUDE_PUBLISHED_SAME_YEAR' and q_planning_year = 1999 then 0 else 1 end last_year from q0)"""
        r = f"r as (select * from records where {ok})"
    t, v, d = ("(case when list_has_any(q_types, type_tokens) then 1.0 else 0.1 end)", "(case when q_venue = venue_type then 1.0 when q_venue = '4-NOT SPECIFIED' or venue_type = '4-NOT SPECIFIED' then 0.45 else 0.25 end)", "exp(-abs(ln((q_duration + 1.0::double) / (duration_days + 1.0::double))))")
    g = "(case when q_district = district then 1.0 when q_region = region then 0.8 else 0.3 end)"
    if single:
        sim = f"0.4::double * {t} + 0.25::double * {g} + 0.2::double * {v} + 0.15::double * (case when duration_days is null then 0.35 else {d} end)"
    else:
        hv, hd = "q_venue is not null and venue_type is not null", "q_duration is not null and duration_days is not null"
        sim = f"(0.4::double * {t} + 0.25::double * {g} + case when {hv} then 0.2::double * {v} else 0 end + case when {hd} then 0.15::double * {d} else 0 end) / (0.65::double + case when {hv} then 0.2::double else 0 end + case when {hd} then 0.15::double else 0 end)"
    wv = "true" if single else "q_venue is not null"
    pick = "select e.*, base_tier reached_tier from e join base using (query_id) where tier <= base_tier"
    gate = ""
    if kind == "v1":
        gate = """, b1 as (select query_id, base_tier, base_count, max(sim) best from e join base using (query_id) where tier <= base_tier group by all),
    ext as (select e.query_id, b1.base_tier, base_count, best, greatest(tier, b1.base_tier) lvl, dataset_year, w from e join b1 using (query_id) where tier <= b1.base_tier or sim >= round(best - 0.05, 12)),
    shares as (select query_id, upto, max(yw) / sum(yw) s from (select query_id, u.upto, dataset_year, sum(w) yw from ext join (select unnest([1, 2, 3, 4, 5, 6]) upto) u on u.upto >= base_tier and lvl <= upto group by all) group by all),
    gate as (select query_id, base_tier, base_count, best, base_share, gate, case when gate then round(best - 0.05, 12) end quality_floor, case when gate then coalesce(solved, 6) else base_tier end reached_tier from (
      select *, base_count >= 20 and base_share > 0.5 gate from (select b1.query_id, b1.base_tier, b1.base_count, b1.best, max(round(s, 12)) filter (upto = base_tier) base_share, min(upto) filter (upto > base_tier and round(s, 12) <= 0.5) solved from b1 join shares using (query_id) group by all)))"""
        pick = "select e.*, reached_tier from e join gate using (query_id) where tier <= base_tier or gate and tier <= reached_tier and sim >= quality_floor"
    local = "case when q_district is not null then case tier when 1 then 1.0 when 2 then 0.5 when 4 then 0.5 else 0 end else case when tier in (2, 4) then 1.0 else 0 end end"
    quantile = lambda p: f"max(case when i = 1 and {p} <= cf then value when ncf is null and {p} >= cf then value when cf <= {p} and {p} <= ncf then value + (nv - value) * case when ncf > cf then ({p} - cf) / (ncf - cf) else 0 end end) p{round(p * 100)}"
    return f"""with {RECORDS_SQL}, {r}, {qs},
    e0 as (select *, round({sim}, 12) sim, case when {wv} and q_district is not null and list_has_any(q_types, type_tokens) and q_venue = venue_type and q_district = district then 1
      when {wv} and list_has_any(q_types, type_tokens) and q_venue = venue_type and q_region = region then 2 when {wv} and list_has_any(q_types, type_tokens) and q_venue = venue_type then 3
      when list_has_any(q_types, type_tokens) and q_region = region then 4 when list_has_any(q_types, type_tokens) then 5 else 6 end tier from r join q on dataset_year between first_year and last_year),
    e as (select *, sim * sim w from e0),
    bounds as (select query_id, quantile_cont(ln(budget_krw), 0.05) lo, quantile_cont(ln(budget_krw), 0.95) hi from e where list_has_any(q_types, type_tokens) and budget_krw > 0 group by all),
    cum as (select query_id, tier, sum(count(*)) over (partition by query_id order by tier) k from e group by query_id, tier),
    base as (select query_id, coalesce(min(tier) filter (k >= 20), 6) base_tier, coalesce(min(k) filter (k >= 20), max(k)) base_count from cum group by all){gate},
    chosen as ({pick}),
    ranked as (select *, row_number() over (partition by query_id order by sim desc, tier, id) rn from chosen where sim >= 0.35),
    adj as (select ranked.*, lo, hi, case when q_duration is null or coalesce(duration_days, 0) <= 0 then budget_krw else budget_krw * pow(greatest(0.5, least(2.0, q_duration / duration_days::double)), 0.55::double) end adjusted from ranked left join bounds using (query_id) where rn <= 50),
    sample as (select *, exp(greatest(coalesce(lo, '-infinity'::double), least(coalesce(hi, 'infinity'::double), ln(adjusted)))) as value from adj),
    hz as (select *, (sum(w) over (partition by query_id order by value, rn rows unbounded preceding) - 0.5 * w) / sum(w) over (partition by query_id) cf, row_number() over (partition by query_id order by value, rn) i from sample),
    hz2 as (select *, lead(value) over (partition by query_id order by value, rn) nv, lead(cf) over (partition by query_id order by value, rn) ncf from hz),
    qs as (select query_id, {quantile(0.25)}, {quantile(0.5)}, {quantile(0.6)}, {quantile(0.75)} from hz2 group by query_id),
    st as (select query_id, count(*) sample_count, sum(value * w) / sum(w) weighted_average, exp(sum(ln(value) * w) / sum(w)) estimated, sum(sim * w) / sum(w) similarity_avg,
      sum(case when duration_days is not null then w else 0 end) / sum(w) completeness, sum(w) * sum(w) / sum(w * w) ess, sum(w * ({local})) / sum(w) local_evidence, min(sim) similarity_min,
      min(dataset_year) earliest_source_year, max(dataset_year) latest_source_year, count(distinct dataset_year) distinct_years, max(reached_tier) reached_tier from sample group by query_id),
    c1 as (select *, 100 * (0.3::double * least(sample_count / 25.0::double, 1) + 0.4::double * similarity_avg + 0.2::double * (1 - least((p75 - p25) / greatest(p50, 1), 1.5) / 1.5::double) + 0.1::double * completeness) c0 from st join qs using (query_id)),
    c2 as (select *, case when sample_count < 5 then least(c0, 55) else c0 end confidence from c1),
    stats as (select *, 0.05::double + (1 - confidence / 100) * 0.1::double contingency_rate, greatest(estimated, p60) * (1 + 0.05::double + (1 - confidence / 100) * 0.1::double) recommended,
      case when sample_count < 3 then 'LOW' when confidence >= 80 then 'HIGH' when confidence >= 60 then 'MEDIUM' else 'LOW' end as level,
      100 * (0.2::double * (1 - exp(-ess / 15)) + 0.35::double * similarity_avg + 0.2::double * exp(-greatest(ln(p75 / p25), 0) / 2) + 0.1::double * completeness + 0.15::double * local_evidence) data_quality from c2)
    {tail}"""


ESTIMATE_COLUMNS = ("weighted_average", "estimated", "recommended", "p25", "p50", "p60", "p75")


def _result(stats: DataFrame, qs: DataFrame) -> DataFrame:
    """Every query has a row; one without a sample has zeros and no tier."""
    got = qs.select("query_id").join(stats, "query_id", "left")
    money = [F.coalesce(S.half_up(c(x)), F.lit(0).cast("long")).alias(x) for x in ESTIMATE_COLUMNS]
    score = [F.coalesce(F.round(x, 4), F.lit(0.0)).alias(x) for x in ("similarity_avg", "confidence", "data_quality", "contingency_rate")]
    return got.select("query_id", F.coalesce("sample_count", F.lit(0).cast("long")).alias("sample_count"), F.coalesce("reached_tier", F.lit(0)).alias("reached_tier"), F.coalesce("level", F.lit("NONE")).alias("level"), *money, *score, "earliest_source_year", "latest_source_year")


RESULT_SQL = (
    "select q.query_id, coalesce(sample_count, 0) sample_count, coalesce(reached_tier, 0) reached_tier, coalesce(level, 'NONE') as level, "
    + ", ".join(f"coalesce(cast(floor({x} + 0.5) as bigint), 0) {x}" for x in ESTIMATE_COLUMNS)
    + ", "
    + ", ".join(f"coalesce(round({x}, 4), 0) {x}" for x in ("similarity_avg", "confidence", "data_quality", "contingency_rate"))
    + ", earliest_source_year, latest_source_year from q left join stats using (query_id)"
)


@query(_sql("single", RESULT_SQL))
def single_year_estimate(spark, sf_dir):
    return _result(estimate.core_stats(_sample(spark, sf_dir, "single")), requests.frame(spark, requests.SINGLE))


@query(_sql("v0", RESULT_SQL))
def baseline_estimate(spark, sf_dir):
    return _result(estimate.core_stats(_sample(spark, sf_dir, "v0")), _queries(spark))


@query(_sql("v1", RESULT_SQL))
def planning_batch(spark, sf_dir):
    return _result(estimate.core_stats(_sample(spark, sf_dir, "v1")), _queries(spark))


TIERS_SQL = "select query_id, cast(tier as integer) tier, count(*) as added, cast(sum(count(*)) over (partition by query_id order by tier) as bigint) cumulative from e group by query_id, tier"


def _tiers(every):
    return every.groupBy("query_id", "tier").agg(F.sum("n").alias("added")).withColumn("cumulative", F.sum("added").over(Window.partitionBy("query_id").orderBy("tier")))


@query(_sql("single", TIERS_SQL))
def single_year_tiers(spark, sf_dir):
    return _tiers(_scored(spark, sf_dir, True))


@query(_sql("v0", TIERS_SQL))
def multi_year_tiers(spark, sf_dir):
    return _tiers(_scored(spark, sf_dir))


@query(_sql("v0", "select query_id, tier, round(sim, 6) sim, count(*) n from e group by all"))
def similarity_scores(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("query_id", "tier", F.round("sim", 6).alias("sim")).agg(F.sum("n").alias("n"))


@query(_sql("v0", "select query_id, round(lo, 6) lo, round(hi, 6) hi from bounds"))
def winsor_bounds(spark, sf_dir):
    index, queries = _index(spark, sf_dir)
    return index.winsor(queries).select("query_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(_sql("v0", "select query_id, base_tier, cast(base_count as bigint) base_count, count(*) window_rows, count(distinct case when tier <= base_tier then hash(dataset_year, region, district, type_tokens, venue_type, duration_days) end) scored_cells from e join base using (query_id) group by all"))
def tier_index_reads(spark, sf_dir):
    """What each request reads by the index: the cells that it scores, beside the records of its window."""
    index, queries = _index(spark, sf_dir)
    windows = selection.by_year(queries, *index.years).join(index.levels.where("kind = 'a'").select("dataset_year", "n"), "dataset_year").groupBy("query_id").agg(F.sum("n").alias("window_rows"))
    base = index.base(queries).groupBy("query_id", "base_tier", "base_count").agg(F.count("*").alias("scored_cells"))
    return base.join(windows, "query_id").select("query_id", "base_tier", "base_count", "window_rows", "scored_cells")


@query(f"""with {RECORDS_SQL}, r as (select * from records where quality_flag = 'VALID' and region is not null and len(type_tokens) > 0)
select kind, district, region, venue_type, dataset_year, array_to_string(type_tokens, '|') types, n from (
  select 'drv' kind, district, region, venue_type, dataset_year, type_tokens, count(*) n from r group by all union all select 'dv', district, '', venue_type, dataset_year, type_tokens, count(*) from r group by all
  union all select 'rv', '', region, venue_type, dataset_year, type_tokens, count(*) from r group by all union all select 'v', '', '', venue_type, dataset_year, type_tokens, count(*) from r group by all
  union all select 'r', '', region, '', dataset_year, type_tokens, count(*) from r group by all union all select 't', '', '', '', dataset_year, type_tokens, count(*) from r group by all union all select 'a', '', '', '', dataset_year, null, count(*) from r group by all)""")
def tier_index_levels(spark, sf_dir):
    levels = _index(spark, sf_dir)[0].levels
    return levels.select("kind", "district", "region", "venue_type", "dataset_year", F.when(c("kind") != "a", F.array_join("type_tokens", "|")).alias("types"), "n")


CANDIDATE_SQL = "select query_id, cast(rn as integer) rn, id, tier, round(sim, 6) sim, cast(floor(adjusted + 0.5) as bigint) adjusted, cast(floor(value + 0.5) as bigint) as value, array_to_string(type_tokens, '|') types from sample"


def _candidates(sample):
    return sample.select("query_id", "rn", "id", "tier", F.round("sim", 6).alias("sim"), S.half_up(c("adjusted")).alias("adjusted"), S.half_up(c("value")).alias("value"), F.array_join("type_tokens", "|").alias("types"))


@query(_sql("v0", CANDIDATE_SQL))
def v0_selection(spark, sf_dir):
    return _candidates(_sample(spark, sf_dir, "v0"))


@query(_sql("v1", CANDIDATE_SQL))
def v1_selection(spark, sf_dir):
    return _candidates(_sample(spark, sf_dir, "v1"))


@query(_sql("single", "select query_id, cast(rn as integer) rn, id, round(sim, 3) similarity, cast(floor(adjusted + 0.5) as bigint) adjusted from sample where rn <= 5"))
def similar_top5(spark, sf_dir):
    return _sample(spark, sf_dir, "single").where("rn <= 5").select("query_id", "rn", "id", F.round("sim", 3).alias("similarity"), S.half_up(c("adjusted")).alias("adjusted"))


@query(_sql("v1", "select query_id, base_tier, cast(base_count as bigint) base_count, round(base_share, 6) base_share, round(best, 6) best, gate, round(quality_floor, 6) quality_floor, reached_tier from gate"))
def v1_gate_diagnostics(spark, sf_dir):
    index, queries = _index(spark, sf_dir)
    got = selection.gate(materialise(index.base(queries), "base"), index.wider(queries))[0]
    return got.select("query_id", "base_tier", "base_count", F.round("base_share", 6).alias("base_share"), F.round("best", 6).alias("best"), "gate", F.round("quality_floor", 6).alias("quality_floor"), "reached_tier")


@query(_sql("v1", "select query_id, dataset_year, count(*) n, round(sum(w) / sum(sum(w)) over (partition by query_id), 6) share from sample group by query_id, dataset_year"))
def year_weight_breakdown(spark, sf_dir):
    return estimate.year_breakdown(_sample(spark, sf_dir, "v1")).withColumn("share", F.round("share", 6))


@query(_sql("v1", "select query_id, round(1 / sum(s * s), 6) effective_years, round(max(s), 6) max_year_share, round(arg_max(s, dataset_year), 6) latest_year_share from (select query_id, dataset_year, sum(w) / sum(sum(w)) over (partition by query_id) s from sample group by query_id, dataset_year) group by query_id"))
def effective_year_count(spark, sf_dir):
    got = estimate.effective_years(_sample(spark, sf_dir, "v1"))
    return got.select("query_id", *(F.round(x, 6).alias(x) for x in ("effective_years", "max_year_share", "latest_year_share")))


@query(_sql("single", "select query_id, tier, round(100 * sum(w) / sum(sum(w)) over (partition by query_id), 4) pct, cast(row_number() over (partition by query_id order by min(rn)) as integer) ord from sample group by query_id, tier"))
def scope_weight_breakdown(spark, sf_dir):
    return estimate.scope_breakdown(_sample(spark, sf_dir, "single")).withColumn("pct", F.round("pct", 4))


@query(_sql("v1", "select query_id, round(ess, 6) ess, round(local_evidence, 6) local_evidence, round(completeness, 6) completeness, round(data_quality, 4) data_quality from stats"))
def data_quality_v3(spark, sf_dir):
    got = estimate.core_stats(_sample(spark, sf_dir, "v1"))
    return got.select("query_id", *(F.round(x, 6).alias(x) for x in ("ess", "local_evidence", "completeness")), F.round("data_quality", 4).alias("data_quality"))


@query(_sql("v0", "select query_id, round(p25, 2) p25, round(p50, 2) p50, round(p60, 2) p60, round(p75, 2) p75 from qs"))
def weighted_quantiles(spark, sf_dir):
    got = estimate.weighted_quantiles(_sample(spark, sf_dir, "v0"), (0.25, 0.5, 0.6, 0.75))
    return got.select("query_id", *(F.round(x, 2).alias(x) for x in ("p25", "p50", "p60", "p75")))


@query(_sql("single", "select query_id, round(100 * (0.2::double * least(ess / 30, 1) + 0.35::double * similarity_avg + 0.25::double / (1 + greatest(ln(p75 / p25), 0)) + 0.1::double * completeness + 0.1::double * [1.0, 0.9, 0.7, 0.6, 0.45, 0.3][reached_tier]), 4) v11, round(100 * (0.2::double * least(ess / 30, 1) + 0.4::double * similarity_avg + 0.3::double / (1 + greatest(ln(p75 / p25), 0)) + 0.1::double * completeness), 4) v12, round(confidence, 4) v10 from stats"))
def confidence_versions(spark, sf_dir):
    got = estimate.core_stats(_sample(spark, sf_dir, "single"))
    capped = lambda x: F.when(c("sample_count") < 5, F.least(x, F.lit(55.0))).otherwise(x)
    sample, stable = F.least(c("ess") / 30, F.lit(1.0)), 1 / (1 + F.greatest(F.ln(c("p75") / c("p25")), F.lit(0.0)))
    scope = F.element_at(F.array(*map(F.lit, (1.0, 0.9, 0.7, 0.6, 0.45, 0.3))), c("reached_tier"))
    v11 = 100 * (0.20 * sample + 0.35 * c("similarity_avg") + 0.25 * stable + 0.10 * c("completeness") + 0.10 * scope)
    v12 = 100 * (0.20 * sample + 0.40 * c("similarity_avg") + 0.30 * stable + 0.10 * c("completeness"))
    return got.select("query_id", F.round(capped(v11), 4).alias("v11"), F.round(capped(v12), 4).alias("v12"), F.round("confidence", 4).alias("v10"))


@query(f"with {RECORDS_SQL} select target, count(*) filter (quality_flag <> 'VALID') low_quality, count(*) filter (quality_flag = 'VALID' and len(type_tokens) = 0) missing_feature, count(*) filter (quality_flag = 'VALID' and len(type_tokens) > 0) pool from records join (select unnest([1996, 1998, 2000]) target) on dataset_year < target group by target")
def training_pool_counts(spark, sf_dir):
    targets = F.explode(F.filter(F.array(*map(F.lit, (1996, 1998, 2000))), lambda t: t > c("dataset_year"))).alias("target")
    rows = records(spark, sf_dir, ("dataset_year", "quality_flag", "type_tokens")).select("quality_flag", "type_tokens", targets)
    low, untyped = c("quality_flag") != "VALID", F.size("type_tokens") == 0
    return rows.groupBy("target").agg(F.count_if(low).alias("low_quality"), F.count_if(~low & untyped).alias("missing_feature"), F.count_if(~low & ~untyped).alias("pool"))


@query(_sql("v0", "select q.query_id, q_planning_year - last_year = 0 same_year, last_year, count(id) n, min(dataset_year) earliest, max(dataset_year) latest from q left join r on dataset_year <= last_year group by all"))
def reference_pool(spark, sf_dir):
    index, qs = _index(spark, sf_dir)
    counts = index.scored(qs).groupBy("query_id").agg(F.sum("n").alias("n"), F.min("dataset_year").alias("earliest"), F.max("dataset_year").alias("latest"))
    return qs.join(counts, "query_id", "left").select("query_id", (c("applied_policy") == policy.SAME_YEAR).alias("same_year"), "last_year", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "earliest", "latest")


@query("with " + requests.sql(requests.MULTI) + " select query_id, case when q_policy = 'INCLUDE_PUBLISHED_SAME_YEAR' and q_planning_year = 1999 then q_policy else 'HISTORICAL_ONLY' end applied_policy from q0")
def policy_resolution(spark, sf_dir):
    return _queries(spark).select("query_id", "applied_policy")


@query(f"with {RECORDS_SQL} select dataset_year, count(*) record_count, case when dataset_year = 1999 then 'PUBLISHED_PLAN_COMPLETE' else 'PARTIAL' end status from records group by dataset_year")
def publication_status_list(spark, sf_dir):
    return policy.status_by_year(records(spark, sf_dir, ("dataset_year",)), policy.status_table(spark)).drop("published_at")


@query("select * from (values (1998, 'PUBLISHED_PLAN_COMPLETE', true), (1999, 'PARTIAL', false), (2000, 'PARTIAL', false)) t(dataset_year, status, published)")
def publication_status_upsert(spark, sf_dir):
    changes = spark.createDataFrame([(1998, policy.COMPLETE), (1999, policy.PARTIAL)], "dataset_year int, status string")
    return policy.upsert(policy.status_table(spark), changes, "2001-02-03 04:05:06").select("dataset_year", "status", c("published_at").isNotNull().alias("published"))


# ---------------------------------------------------------------- planning

REGION, KIND, VENUE, DAYS, MONTH = "ASIA", "BUILDING", "1-URGENT", 3, 5


def _corpus(spark, sf_dir, *columns):
    """What the planner reads: the records of the latest year, with ``columns`` or all."""
    return records(spark, sf_dir, columns or COLUMNS, only_latest=True)


def _names(spark, sf_dir):
    rows = _stored(spark, sf_dir, COLUMNS, True)
    return rows, rows.select("id", "region", planner.tokens(c("festival_name"), planner.corpus_terms(rows)).alias("tokens"))


def _words(spark, sf_dir):
    rows, names = _names(spark, sf_dir)
    return rows, materialise(planner.keywords(names, planner.vocabulary(names)), "keywords")


# names of these tables hold nothing to take out, so plain words of 2 to 8 letters are the tokens
WORDS_SQL = f"""with {LATEST_SQL}, tk as (select id, unnest(list_distinct(list_filter(string_split(festival_name, ' '), lambda t: length(t) between 2 and 8 and t not in ('with', 'and', 'the', 'in', 'of')))) token from records),
vocab as (select token, count(*) df, min(id) first_seen from tk group by token having count(*) >= 2), kw as (select id, token as keyword from tk where token in (select token from vocab))"""


@query(WORDS_SQL + " select * from vocab")
def keyword_vocabulary(spark, sf_dir):
    return planner.vocabulary(_names(spark, sf_dir)[1])


@query(WORDS_SQL + " select keyword, count(*) n from kw group by keyword")
def keyword_extract(spark, sf_dir):
    return _words(spark, sf_dir)[1].groupBy("keyword").agg(F.count("*").alias("n"))


@query(f"""with {LATEST_SQL}, tk as (select id, list_filter(string_split(festival_name, ' '), lambda t: length(t) between 2 and 8 and t not in ('with', 'and', 'the', 'in', 'of')) t from records)
select array_to_string(t, ' ') tokens, count(*) n from tk group by all""")
def keyword_removals(spark, sf_dir):
    """Names with the record's own district and region, a number, a year and generic terms around and inside them: the tokens are those of the bare name."""
    rows = _stored(spark, sf_dir, COLUMNS, True)
    name = F.concat(c("district"), F.lit("제3회 "), c("region"), F.lit("특별시축제 "), F.replace("festival_name", F.lit(" "), F.concat(F.lit(" "), c("district"), F.lit(" "))), F.lit(" 대축제(2024) 2024년"), c("region"), F.lit("도"))
    return rows.groupBy(F.array_join(planner.tokens(name, planner.corpus_terms(rows)), " ").alias("tokens")).agg(F.count("*").alias("n"))


MONTHS_SQL = f"""mo as (select m.month, count(id) as national, count(id) filter (region = '{REGION}') regional, count(id) filter (region = '{REGION}' and festival_type = '{KIND}') same_type
from (select unnest(range(1, 13)) as month) m left join records on start_month = m.month group by m.month)"""


@query(f"with {LATEST_SQL}, {MONTHS_SQL} select cast(month as integer) as month, national, regional, same_type, case when same_type >= 6 then 'HIGH' when same_type >= 3 then 'MEDIUM' else 'LOW' end as level from mo")
def month_distribution(spark, sf_dir):
    return planner.months(spark, _corpus(spark, sf_dir, "start_month", "region", "festival_type"), REGION, KIND)


@query(f"with {LATEST_SQL}, {MONTHS_SQL} select cast(month as integer) as month, same_type, national from mo where national > 0 order by same_type, national desc, month limit 3")
def quiet_months(spark, sf_dir):
    return planner.quiet_months(planner.months(spark, _corpus(spark, sf_dir, "start_month", "region", "festival_type"), REGION, KIND)).select("month", "same_type", "national")


SPACE_SQL = WORDS_SQL + f""", s as (select * from records where festival_type = '{KIND}'), ax as (
  select id, region, 'venue' axis, venue_type as val from s where venue_type <> '4-NOT SPECIFIED' union all select id, region, 'month', cast(start_month as varchar) from s
  union all select id, region, 'duration', case when duration_days between 1 and 2 then '1-2' when duration_days between 3 and 4 then '3-4' when duration_days between 5 and 7 then '5-7' when duration_days between 8 and 14 then '8-14' when duration_days >= 15 then '15+' end from s
  union all select s.id, region, 'keyword', keyword from s join kw on kw.id = s.id),
space as (select axis, val as "value", count(distinct id) as national, count(distinct id) filter (region = '{REGION}') regional, min(id) first_seen,
  round(least(1, count(distinct id) / 12.0::double) * (1 - least(1, count(distinct id) filter (region = '{REGION}') / greatest(1, (select count(*) from s where region = '{REGION}'))::double)), 4) score
  from ax where val is not null group by axis, val having count(distinct id) >= 3)"""


def _space(axis: str) -> Callable:
    def run(spark, sf_dir):
        rows, words = _words(spark, sf_dir)
        return planner.whitespace(planner.axis_values(rows.where(c("festival_type") == KIND), words), REGION).where(c("axis") == axis)

    run.__name__ = f"whitespace_{axis}"
    return query(SPACE_SQL + f" select axis, \"value\", national, regional, score, first_seen from space where axis = '{axis}'")(run)


for _axis in ("venue", "month", "duration", "keyword"):
    _space(_axis)

COHORT_SQL = f"""co as (select * from records where festival_type = '{KIND}' and (region = '{REGION}' or (select count(*) from records where festival_type = '{KIND}' and region = '{REGION}') < 8)),
cpv as (select *, budget_krw / visitors as cpv from co where visitors >= 1000 and budget_krw > 0)"""
COST_SQL = """cost as (select cast(max(n) as bigint) n, cast(floor(quantile_cont(cpv, 0.5) + 0.5) as bigint) as med, cast(floor(quantile_cont(cpv, 0.25) + 0.5) as bigint) p25, cast(floor(quantile_cont(cpv, 0.75) + 0.5) as bigint) p75
from (select cpv, row_number() over (order by cpv, id) k, count(*) over () n from cpv) where n < 20 or k > floor(n * 0.05::double) and k <= ceil(n * 0.95::double))"""


@query(f"with {LATEST_SQL}, {COHORT_SQL}, {COST_SQL} select n, med as \"median\", p25, p75 from cost")
def cost_per_visitor_summary(spark, sf_dir):
    return planner.cost_summary(planner.cohort(_corpus(spark, sf_dir, "id", "region", "festival_type", "budget_krw", "visitors"), REGION, KIND))


@query(f"with {LATEST_SQL}, {COHORT_SQL} select id, round(cpv, 6) cpv from cpv where visitors >= (select quantile_cont(visitors, 0.5) from cpv) order by cpv.cpv, id limit 5")
def top_efficient(spark, sf_dir):
    return planner.top_efficient(planner.cohort(_corpus(spark, sf_dir, "id", "region", "festival_type", "budget_krw", "visitors"), REGION, KIND)).select("id", F.round("cpv", 6).alias("cpv"))


@query(f"with {LATEST_SQL} select count(*) filter (festival_type = '{KIND}') national_same_type, count(*) filter (region = '{REGION}') region, count(*) filter (festival_type = '{KIND}' and region = '{REGION}') region_same_type, count(*) filter (festival_type = '{KIND}' and region = '{REGION}' and venue_type = '{VENUE}') region_same_type_venue from records")
def cohort_summary(spark, sf_dir):
    return planner.cohort_summary(_corpus(spark, sf_dir, "region", "festival_type", "venue_type"), REGION, KIND, VENUE)


PCT = "cast(floor(least(1, greatest(0, {})) * 100 + 0.5) as integer)"


@query(SPACE_SQL + f""", {MONTHS_SQL}, {COHORT_SQL}, {COST_SQL},
  best as (select *, row_number() over (partition by axis order by score desc, national desc, first_seen, "value") k from space where axis = 'venue' and "value" <> '{VENUE}' or axis = 'duration' and "value" <> '3-4' or axis = 'keyword' and regional = 0),
  qm as (select * from mo where national > 0 order by same_type, national desc, month limit 3),
  quiet as (select * from qm order by month = {MONTH}, same_type, national desc, month limit 1)
select 'VENUE_SHIFT' kind, "value", null partner, {PCT.format('score')} score, 1 emitted from best where k = 1 and axis = 'venue'
union all select 'TIMING_SHIFT', cast(month as varchar), null, {PCT.format("1 - same_type / greatest(1, (select count(*) from s where region = '" + REGION + "'))::double")}, 2 from quiet
union all select 'KEYWORD_MASHUP', "value", (select keyword from kw join records using (id) where region = '{REGION}' and keyword <> best."value" group by keyword order by count(*) desc, min(id), keyword limit 1), {PCT.format('score')}, 3 from best where k = 1 and axis = 'keyword'
union all select 'DURATION_TUNE', "value", null, {PCT.format('score')}, 4 from best where k = 1 and axis = 'duration'
union all select 'BUDGET_EFFICIENCY', cast(med as varchar), null, 0, 5 from cost where n > 0""")
def recommendation_cards(spark, sf_dir):
    rows, words = _words(spark, sf_dir)
    return planner.cards(spark, rows, words, REGION, KIND, VENUE, MONTH, DAYS)


# ---------------------------------------------------------------- sources and data quality


@query(f"with {LATEST_SQL} select region, list_sort(list(distinct district)) districts from records where district <> '' group by region")
def districts_by_region(spark, sf_dir):
    return planner.districts_by_region(_corpus(spark, sf_dir, "region", "district"))


@query(f"with {RECORDS_SQL} select region, count(*) n, cast(floor(sum(budget_krw) + 0.5) as bigint) total from records where dataset_year = (select max(dataset_year) from records) and quality_flag = 'VALID' group by region")
def latest_year_scan(spark, sf_dir):
    return _corpus(spark, sf_dir, "region", "quality_flag", "budget_krw").where("quality_flag = 'VALID'").groupBy("region").agg(F.count("*").alias("n"), S.half_up(F.sum("budget_krw")).alias("total"))


@query(f"""with {RECORDS_SQL}, v as (select *, case when quality_flag = 'VALID' then budget_krw end b from records) select dataset_year, count(*) n, count(*) filter (quality_flag = 'VALID') n_valid, count(*) filter (quality_flag <> 'VALID') n_not_valid,
count(*) filter (duration_days is null) no_duration, count(*) filter (len(type_tokens) = 0) no_type, count(*) filter (len(type_tokens) = 1) single_type, count(*) filter (len(type_tokens) > 1) multi_type, count(distinct region) regions,
round(quantile_cont(b, 0.5), 4) as "median", round(quantile_cont(b, 0.25), 4) p25, round(quantile_cont(b, 0.75), 4) p75, round(min(b), 4) as "least", round(max(b), 4) as "most" from v group by dataset_year""")
def import_profile(spark, sf_dir):
    got = ingest.profile(records(spark, sf_dir, ("dataset_year", "region", "type_tokens", "duration_days", "budget_krw", "quality_flag")))
    return got.select(*(F.round(x, 4).alias(x) if x in ("median", "p25", "p75", "least", "most") else x for x in got.columns))


def _raw(spark, sf_dir):
    """Orders as raw text rows, some of them faulty."""
    o = table(spark, sf_dir, "orders").withColumn("k", c("o_orderkey") % 10)
    blank = F.lit(None).cast("string")
    fields = {
        "dataset_year": F.when(c("k") == 1, "x").otherwise(F.year("o_orderdate").cast("string")), "source_sheet": F.lit(" s "), "source_row": c("o_orderkey").cast("string"), "source_sha256": F.sha2(c("o_orderkey").cast("string"), 256),
        "region": F.when(c("k") == 2, F.concat(F.lit("?"), (c("o_orderkey") % 7).cast("string"))).otherwise("서울"), "region_raw": F.lit("서울시"), "district_raw": F.lit("-"), "festival_name": F.when(c("k") == 3, "  ").otherwise("n"), "festival_type": F.when(c("k") == 4, "A| B |A|Z").otherwise("A"),
        "venue_type": F.when(c("k") == 5, F.concat(F.lit("none"), (c("o_orderkey") % 3).cast("string"))).otherwise(blank), "duration_days": F.lit("2.5"), "covid_affected": F.lit("True"), "budget_total_million": F.replace(F.format_number(c("o_totalprice") / 1000, 3), F.lit(","), F.lit("")), "budget_quality_flag": F.when(c("k") == 6, "ODD").otherwise("VALID"),
    }
    return o.select(*(v.alias(k) for k, v in fields.items()))


def _canonical(spark, sf_dir):
    return ingest.canonical(_raw(spark, sf_dir), {"서울": "SEOUL"}, ["A", "B"], {"v": "V"})


@query("select field, fatal, count(*) n from (select unnest(case o_orderkey % 10 when 1 then [{'field': 'dataset_year', 'fatal': true}] when 2 then [{'field': 'region', 'fatal': false}] when 3 then [{'field': 'festival_name', 'fatal': true}] when 4 then [{'field': 'festival_type', 'fatal': false}] when 5 then [{'field': 'venue_type', 'fatal': false}] when 6 then [{'field': 'budget_quality_flag', 'fatal': true}] else [] end, recursive := true) from orders) group by all")
def row_issues(spark, sf_dir):
    return _canonical(spark, sf_dir).select(F.explode("issues").alias("i")).groupBy("i.field", "i.fatal").agg(F.count("*").alias("n"))


@query("select array_to_string(t, '|') types, array_to_string(u, '|') unknown, count(*) n from (select case when o_orderkey % 10 = 4 then ['A', 'B'] else ['A'] end t, case when o_orderkey % 10 = 4 then ['Z'] else [] end u from orders) group by all")
def parse_types(spark, sf_dir):
    return _canonical(spark, sf_dir).groupBy(F.array_join("type_tokens", "|").alias("types"), F.array_join("unknown_types", "|").alias("unknown")).agg(F.count("*").alias("n"))


@query("select count(*) n, cast(sum(cast(cast(printf('%.3f', o_totalprice / 1000) as decimal(18,3)) * 1000000 as bigint)) as bigint) krw, cast(3 as integer) as days from orders")
def canonical_budgets(spark, sf_dir):
    return _canonical(spark, sf_dir).agg(F.count("*").alias("n"), F.sum("budget_krw").alias("krw"), F.max("duration_days").alias("days"))


@query(f"with {RECORDS_SQL} select region, sha256(string_agg(k, ';' order by k)) digest from (select region, dataset_year || ':' || id k from records where festival_type = '{KIND}') group by region")
def natural_key_hash(spark, sf_dir):
    return records(spark, sf_dir).where(c("festival_type") == KIND).groupBy("region").agg(parity.key_set_hash(F.concat_ws(":", "dataset_year", "id")).alias("digest"))


@query(f"with {RECORDS_SQL} select region, count(*) n, cast(sum(h) as decimal(38, 0)) total from (select region, cast('0x' || substr(sha256(dataset_year || ':' || id), 1, 15) as bigint) h from records) group by region")
def key_set_digest(spark, sf_dir):
    """The keys of every region as sums of hashes, of all records."""
    return parity.set_digest(records(spark, sf_dir, ("id", "dataset_year", "region")), ["region"], F.concat_ws(":", "dataset_year", "id")).drop("mixed")


@query(f"with {RECORDS_SQL} select id, dataset_year, cast(1 as bigint) want, cast(case when id % 5000 = 17 then 0 else 1 end as bigint) got from records where id % 5000 = 17 or id % 7000 = 23 and id % 5000 <> 17 union all select -1, 1990, 0, 1")
def key_set_drilldown(spark, sf_dir):
    """The records against a copy of them that lacks some, has another budget in others, and one more: these are named, the others never compared."""
    rows = records(spark, sf_dir, ("id", "dataset_year", "budget_krw"))
    other = rows.where("id % 5000 <> 17").withColumn("budget_krw", F.when(c("id") % 7000 == 23, c("budget_krw") + 1).otherwise(c("budget_krw")))
    other = other.union(spark.createDataFrame([(-1, 1990, 0.0)], other.schema))
    return parity.set_differences(rows, other, ["id", "dataset_year"], ["budget_krw"])


@query("select * from (values (1997, 'a', 'b', '1'), (1998, 'a', 'b', '2')) t(dataset_year, source_sha256, canonical_sha256, importer_version)")
def batch_idempotency(spark, sf_dir):
    schema = "dataset_year int, source_sha256 string, canonical_sha256 string, importer_version string"
    new = spark.createDataFrame([(1996, "a", "b", "1"), (1997, "a", "b", "1"), (1998, "a", "b", "2")], schema)
    return ingest.new_batches(new, spark.createDataFrame([(1996, "a", "b", "1"), (1998, "a", "b", "1")], schema))


_AB = "select query_id, sample_count, reached_tier, estimated from stats"


@query(f"""with a as ({_sql('v0', _AB)}), b as ({_sql('v1', _AB)}), f as (
  select 'sample_count' field, a.sample_count is not distinct from b.sample_count and a.query_id is not null and b.query_id is not null ok from a full join b on a.query_id = b.query_id
  union all select 'reached_tier', a.reached_tier is not distinct from b.reached_tier and a.query_id is not null and b.query_id is not null from a full join b on a.query_id = b.query_id
  union all select 'estimated', coalesce(abs(a.estimated - b.estimated) <= 1, false) from a full join b on a.query_id = b.query_id)
select field, count(*) filter (ok) passed, count(*) filter (not ok) failed from f group by field""")
def selector_ab(spark, sf_dir):
    """Both selectors side by side: on how many queries their samples agree."""
    keys = [estimate.core_stats(_sample(spark, sf_dir, k)).select("query_id", "sample_count", "reached_tier", "estimated") for k in ("v0", "v1")]
    return parity.summary(parity.differences(keys[0], keys[1], ["query_id"], ["sample_count", "reached_tier"], {"estimated": 1.0}))


@query("select cast(case when o_orderkey % 3 = 0 then 29 else 1 end as integer) as day, cast(max(days) as integer) most, cast(min(days) as integer) as \"least\", count(*) n from (select o_orderkey, o_orderdate::date - date '1992-01-01' as days from orders) group by all")
def day_counts(spark, sf_dir):
    start = ingest.rolled_date(F.lit(1991), F.lit(13), F.lit(1))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.datediff("o_orderdate", start).alias("days"))
    return rows.groupBy(F.when(c("o_orderkey") % 3 == 0, 29).otherwise(1).alias("day")).agg(F.max("days").alias("most"), F.min("days").alias("least"), F.count("*").alias("n"))


from planlens import catalogue_import, catalogue_results  # noqa: E402, F401  they add their queries to QUERIES and ORACLES
