"""Queries of results as a planner sees them: breakdowns, notices, references, diagnostics and checked requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlens.catalogue import KIND, REGION, _corpus, _index, _sample, _sql, _stored, query
from planlens.functions import labels
from planlens.operators import estimate, parity, planner, policy, selection
from planlens.plans import answers, requests, validation
from planlens.sources.records import LATEST_SQL, RECORDS_SQL, records
from planlens.sources.staging import materialise

c = F.col

BREAKDOWN_SQL = """select q.query_id, cast(t.tier as integer) tier, coalesce(k.added, 0) added, cast(sum(coalesce(k.added, 0)) over (partition by q.query_id order by t.tier) as bigint) cumulative
from q join (select unnest([1, 2, 3, 4, 5, 6]) tier) t on (t.tier <> 1 or q_district is not null) and (t.tier > 3 or q_venue is not null)
left join (select query_id, max(reached_tier) reached from chosen group by query_id) m on m.query_id = q.query_id
left join (select query_id, tier, count(*) added from chosen group by all) k on k.query_id = q.query_id and k.tier = t.tier where t.tier <= coalesce(reached, 6)"""


@query(_sql("v0", BREAKDOWN_SQL))
def tier_breakdown_v0(spark, sf_dir):
    index, queries = _index(spark, sf_dir)
    return selection.breakdown(estimate.chosen_cells(index, queries, "v0"), queries)


@query(_sql("v1", BREAKDOWN_SQL))
def tier_breakdown_v1(spark, sf_dir):
    index, queries = _index(spark, sf_dir)
    return selection.breakdown(estimate.chosen_cells(index, queries, "v1"), queries)


def _samples(spark, sf_dir, kind):
    """The samples, at most 50 rows for each query, written out, as several results are taken from them."""
    return materialise(_sample(spark, sf_dir, kind), "sample")


YEARS_SQL = """yr as (select query_id, dataset_year, count(*) n, sum(w) / sum(sum(w)) over (partition by query_id) s from sample group by query_id, dataset_year),
ye as (select query_id, 1 / sum(s * s) effective_years, string_agg(printf('%d:%d:%.6f', dataset_year, n, s), '|' order by dataset_year) breakdown from yr group by query_id),
pl as (select query_id, min(dataset_year) pool_earliest, max(dataset_year) pool_latest from e group by query_id), tp as (select query_id, string_agg(cast(id as varchar), ',' order by rn) top_ids from sample where rn <= 10 group by query_id)"""
_MONEY = ("estimated", "weighted_average", "recommended", "p25", "p50", "p60", "p75")
PLAN_SQL = f""", {YEARS_SQL} select q.query_id, q_planning_year planning_year, q_policy requested_policy, case when last_year = q_planning_year then q_policy else 'HISTORICAL_ONLY' end applied_policy, coalesce(pool_earliest, q_planning_year) year_from, last_year year_to, pool_earliest, pool_latest,
coalesce(sample_count, 0) sample_count, coalesce(distinct_years, 0) distinct_years, earliest_source_year, latest_source_year, coalesce(round(effective_years, 6), 0) effective_years, coalesce(round(ess, 4), 0) ess, coalesce(round(similarity_avg, 6), 0) similarity_avg, coalesce(round(data_quality, 4), 0) data_quality,
{', '.join(f'coalesce(cast(floor({x} + 0.5) as bigint), 0) {x}' for x in _MONEY)}, coalesce(reached_tier, 0) reached_tier, coalesce(breakdown, '') breakdown, coalesce(top_ids, '') top_ids
from q left join stats using (query_id) left join ye using (query_id) left join pl using (query_id) left join tp using (query_id)"""


def _planned(spark, sf_dir):
    index, queries = _index(spark, sf_dir)
    return answers.planned(index, queries)


@query(_sql("v1", PLAN_SQL))
def planning_result(spark, sf_dir):
    return _planned(spark, sf_dir)


@query(_sql("v1", f", {YEARS_SQL} select query_id, dataset_year, n, cast(printf('%.6f', s) as double) share from yr"))
def parsed_year_breakdown(spark, sf_dir):
    return estimate.parsed_breakdown(estimate.breakdown_text(_samples(spark, sf_dir, "v1")))


@query(_sql("single", f"""select q.query_id, coalesce(sample_count, 0) sample_count, case when coalesce(sample_count, 0) > 0 then '{labels.SAMPLE_BASIS.replace('%d', "' || sample_count || '")} / {labels.TYPE_BASIS.replace('%s', "' || q_types[1] || '")} / {labels.REGION_BASIS.replace('%s', "' || q_region || '")} / {labels.VENUE_BASIS.replace('%s', "' || q_venue || '")}' else '' end basis,
case when coalesce(sample_count, 0) = 0 then '{labels.NO_SAMPLE}' else concat_ws(' / ', case when sample_count < 8 then '{labels.SMALL_SAMPLE.replace('%d', "' || sample_count || '")}' end, case when q_venue = '4-NOT SPECIFIED' then '{labels.OPEN_VENUE}' end) end warnings from q left join stats using (query_id)"""))
def estimate_notices(spark, sf_dir):
    """What a single-year estimate rests on and warns of."""
    counts = _samples(spark, sf_dir, "single").groupBy("query_id").agg(F.count("*").alias("sample_count"))
    got = requests.frame(spark, requests.SINGLE).join(counts, "query_id", "left").withColumn("sample_count", F.coalesce("sample_count", F.lit(0).cast("long")))
    basis = labels.estimate_basis(c("sample_count"), F.get("q_types", F.lit(0)), c("q_region"), c("q_venue"))
    return got.select("query_id", "sample_count", F.array_join(basis, " / ").alias("basis"), F.array_join(labels.estimate_warnings(c("sample_count"), c("q_venue")), " / ").alias("warnings"))


COHORTS = [("ASIA", "BUILDING"), ("EUROPE", "NO SUCH TYPE"), ("NOWHERE", "MACHINERY")]


@query(f"""with {LATEST_SQL}, w(region, kind) as (values {', '.join(str(x) for x in COHORTS)}), n as (select w.region, kind, count(id) filter (festival_type = kind) as national, count(id) filter (festival_type = kind and records.region = w.region) regional from w cross join records group by all)
select region, kind, concat_ws(' / ', case when n.national < 10 then '{labels.FEW_OF_TYPE.replace('%s', "' || kind || '").replace('%d', "' || n.national || '")}' end, case when regional = 0 then '{labels.NONE_IN_REGION.replace('%s', "' || region || '", 1).replace('%s', "' || kind || '")}' end) warnings from n""")
def cohort_notices(spark, sf_dir):
    """What recommendations warn of, for several cohorts counted in one pass."""
    asked = spark.createDataFrame(COHORTS, "a_region string, kind string")
    same, here = c("festival_type") == c("kind"), c("region") == c("a_region")
    counts = _corpus(spark, sf_dir).crossJoin(F.broadcast(asked)).groupBy("a_region", "kind").agg(F.count_if(same).alias("national"), F.count_if(same & here).alias("regional"))
    return counts.select(c("a_region").alias("region"), "kind", F.array_join(labels.cohort_warnings(c("national"), c("regional"), c("a_region"), c("kind")), " / ").alias("warnings"))


@query(f"""with {LATEST_SQL}, r as (select *, row_number() over (partition by venue_type order by coalesce(visitors, 0) desc, id) rn from records where festival_type = '{KIND}')
select venue_type, cast(rn as integer) rn, id, festival_name, region region_label, district, festival_type type_label, venue_type venue_label, start_month, duration_days, budget_krw, visitors, case when visitors > 0 then cast(floor(budget_krw / visitors + 0.5) as bigint) end cost_per_visitor from r where rn <= 4""")
def venue_references(spark, sf_dir):
    return planner.references(_corpus(spark, sf_dir).where(c("festival_type") == KIND), ["venue_type"])


@query(f"""with {LATEST_SQL}, r as (select *, row_number() over (partition by start_month order by coalesce(visitors, 0) desc, id) rn from records where festival_type = '{KIND}' and region = '{REGION}')
select start_month as "month", string_agg(cast(id as varchar), ',' order by rn) ids from r where rn <= 4 group by start_month""")
def month_references(spark, sf_dir):
    top = planner.references(_corpus(spark, sf_dir).where((c("festival_type") == KIND) & (c("region") == REGION)).withColumn("month", c("start_month")), ["month"])
    return top.groupBy("month").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"].cast("string")), ",").alias("ids"))


_LISTS = {"region": labels.REGIONS, "festival_type": labels.TYPES, "venue_type": labels.VENUES}
_LISTED = [(kind, i, code, name) for kind, names in _LISTS.items() for i, (code, name) in enumerate(names.items())] + [("duration", i, k, str(v)) for i, (k, v) in enumerate(labels.DURATIONS.items())]


@query(f"""with {LATEST_SQL} select kind, place, code, "label" from (values {', '.join(str(x) for x in _LISTED)}) t(kind, place, code, "label")
union all select 'dataset_year', 0, cast(max(dataset_year) as varchar), cast(count(*) as varchar) from records
union all select 'district', cast(row_number() over (partition by region order by district) - 1 as integer), district, region from (select distinct region, district from records where district <> '')""")
def metadata_listing(spark, sf_dir):
    """All codes with their labels in order, the bounds of durations, the latest year with its number of records, and its districts by region."""
    rows = _corpus(spark, sf_dir, "dataset_year", "region", "district")
    latest = rows.agg(F.max("dataset_year").cast("string").alias("code"), F.count("*").cast("string").alias("label"))
    districts = planner.districts_by_region(rows).select("region", F.posexplode("districts").alias("place", "code"))
    fixed = spark.createDataFrame(_LISTED, "kind string, place int, code string, label string")
    return fixed.union(latest.select(F.lit("dataset_year"), F.lit(0), "code", "label")).union(districts.select(F.lit("district"), "place", "code", "region"))


_AB = "select query_id, count(distinct dataset_year) distinct_years, string_agg(cast(id as varchar), ',' order by id) hash from sample group by query_id"


@query(f"with a as ({_sql('v0', _AB)}), b as ({_sql('v1', _AB)}) select count(*) filter (a.distinct_years = 1 and b.distinct_years > 1) solved, count(*) filter (a.hash = b.hash) unchanged from a join b using (query_id)")
def selector_effects(spark, sf_dir):
    """On how many requests the gate turned a sample of one year into one of several, and on how many it changed nothing."""
    sides = [_sample(spark, sf_dir, k).groupBy("query_id").agg(F.size(F.collect_set("dataset_year")).alias("distinct_years"), parity.key_set_hash(c("id")).alias("hash")) for k in ("v0", "v1")]
    return parity.selector_effects(*sides)


# ---------------------------------------------------------------- requests

REGIONS, TYPES, VENUES = ["ASIA", "EUROPE"], ["BUILDING", "ECONOMY"], ["1-URGENT", "4-NOT SPECIFIED", "5-LOW"]
_WHOLE = '"regionCode": "@region", "festivalType": "@type", "festivalTypes": ["@type"], "venueType": "@venue"'
#: Bodies of requests; each order makes one of these with its own region, type, venue and year.
TEMPLATES = [
    "{" + _WHOLE + ', "durationDays": 3, "planningYear": @year, "startMonth": @month}',
    "{" + _WHOLE + ', "durationDays": 2, "planningYear": @year, "referenceDataPolicy": "INCLUDE_PUBLISHED_SAME_YEAR"}',
    "{" + _WHOLE + ', "durationDays": 4.5, "planningYear": @year, "startMonth": null, "referenceDataPolicy": null}',
    "{" + _WHOLE + ', "durationDays": 1, "planningYear": @year, "referenceDataPolicy": ""}',
    "{" + _WHOLE + ', "durationDays": 0, "planningYear": @year}',
    "{" + _WHOLE + ', "durationDays": "3", "planningYear": @year, "startMonth": "5"}',
    "{" + _WHOLE + ', "durationDays": 3, "planningYear": @year.5, "startMonth": 13}',
    "{" + _WHOLE + ', "durationDays": 3, "planningYear": "@year"}',
    "{" + _WHOLE + ', "durationDays": 3, "planningYear": @year, "referenceDataPolicy": "LATER", "startMonth": 0}',
    "{" + _WHOLE + ', "durationDays": 3, "planningYear": 1800, "referenceDataPolicy": "HISTORICAL_ONLY"}',
    '{"regionCode": "@region", "festivalType": ["@type"], "festivalTypes": ["@type", 1], "venueType": "@venue", "durationDays": 5, "planningYear": @year}',
    '{"regionCode": "@region", "festivalType": "@type", "festivalTypes": "@type", "venueType": "", "durationDays": 5, "planningYear": @year}',
    '{"regionCode": 7, "festivalType": "@type", "festivalTypes": [], "venueType": "@venue", "durationDays": 5, "planningYear": @year}',
    '{"festivalType": "@type", "festivalTypes": ["@type", "BUILDING"], "venueType": true, "durationDays": 5}',
    '["@region", "@type"]',
    "no json of @region",
]


def _bodies(spark, sf_dir):
    """A request for each order."""
    o = records(spark, sf_dir, ("id", "region", "festival_type", "venue_type", "dataset_year", "start_month"))
    body = F.element_at(F.array(*map(F.lit, TEMPLATES)), (F.pmod("id", F.lit(len(TEMPLATES))) + 1).cast("int"))
    for mark, column in {"@region": "region", "@type": "festival_type", "@venue": "venue_type", "@year": "dataset_year", "@month": "start_month"}.items():
        body = F.replace(body, F.lit(mark), c(column).cast("string"))
    return o.select(c("id").alias("request_id"), body.alias("body"))


def _rules_sql(rules: list[tuple[str, str]]) -> str:
    """The rules once more, by DuckDB's own JSON functions over the same bodies."""
    listed = ", ".join("'" + t.replace("'", "''") + "'" for t in TEMPLATES)
    chain = " ".join(f"when not coalesce({holds}, false) then '{name}'" for name, holds in rules)
    return f"""{RECORDS_SQL}, bodies as (select id request_id, replace(replace(replace(replace(replace([{listed}][id % {len(TEMPLATES)} + 1], '@region', region), '@type', festival_type), '@venue', venue_type), '@year', cast(dataset_year as varchar)), '@month', cast(start_month as varchar)) b from records),
    objects as (select request_id, case when json_valid(b) then case when json_type(b) = 'OBJECT' then b end end b from bodies),
    found as (select request_id, b, case when b is null then 'json' {chain} end problem from objects)"""


def _given(n: str) -> str:
    t, v = f"json_type(b, '$.{n}')", f"json_extract_string(b, '$.{n}')"
    return f"case {t} when 'VARCHAR' then {v} <> '' when 'BOOLEAN' then {v} = 'true' when 'NULL' then false when 'ARRAY' then true when 'OBJECT' then true else try_cast({v} as double) <> 0 end"


def _number(n: str) -> str:
    return f"case when json_type(b, '$.{n}') in ('BIGINT', 'UBIGINT', 'DOUBLE') then cast(json_extract_string(b, '$.{n}') as double) end"


def _one_of(n: str, codes: list[str]) -> str:
    return f"json_type(b, '$.{n}') = 'VARCHAR' and json_extract_string(b, '$.{n}') in ({', '.join(repr(x) for x in codes)})"


_COMMON_SQL = [("required", " and ".join(_given(n) for n in ("regionCode", "festivalType", "venueType", "durationDays"))), ("regionCode", _one_of("regionCode", REGIONS)), ("festivalType", _one_of("festivalType", TYPES)), ("venueType", _one_of("venueType", VENUES))]
_MONTH_SQL = f"json_type(b, '$.startMonth') is null or {_number('startMonth')} between 1 and 12"
_EMPTY_SQL = " select request_id, case when problem is not null then 400 when not (select count(*) > 0 from records) then 503 else 200 end status, case when problem is null and not (select count(*) > 0 from records) then 'no data' else problem end problem from found"


def _answered(found, spark, sf_dir):
    """Right requests are refused if there is no record at all."""
    return validation.without_records(found, _corpus(spark, sf_dir, "dataset_year"), 503).select("request_id", "status", "problem")


@query("with " + _rules_sql([*_COMMON_SQL, ("durationDays", f"{_number('durationDays')} >= 2")]) + _EMPTY_SQL)
def checked_single_year(spark, sf_dir):
    return _answered(validation.single_year(_bodies(spark, sf_dir), REGIONS, TYPES, VENUES), spark, sf_dir)


@query("with " + _rules_sql([*_COMMON_SQL, ("durationDays", f"{_number('durationDays')} >= 1"), ("startMonth", _MONTH_SQL), ("planningYear", f"{_number('planningYear')} >= 2000")]) + _EMPTY_SQL)
def checked_planner(spark, sf_dir):
    return _answered(validation.planner(_bodies(spark, sf_dir), REGIONS, TYPES, VENUES), spark, sf_dir)


_TOKENS_SQL = f"len(list_filter(json_extract(b, '$.festivalTypes[*]'), lambda t: json_type(t) <> 'VARCHAR' or json_extract_string(t, '$') not in ({', '.join(repr(x) for x in TYPES)}))) = 0"
_MULTI_SQL = [
    ("required", f"{_given('regionCode')} and json_type(b, '$.festivalTypes') = 'ARRAY' and json_array_length(b, '$.festivalTypes') > 0 and {_given('venueType')} and json_type(b, '$.durationDays') is not null and json_type(b, '$.planningYear') is not null"),
    ("regionCode", _one_of("regionCode", REGIONS)),
    ("festivalTypes", _TOKENS_SQL),
    ("venueType", _one_of("venueType", VENUES)),
    ("durationDays", f"{_number('durationDays')} >= 2"),
    ("planningYear", f"{_number('planningYear')} = floor({_number('planningYear')})"),
    ("referenceDataPolicy", f"coalesce(json_type(b, '$.referenceDataPolicy'), 'NULL') = 'NULL' or json_extract_string(b, '$.referenceDataPolicy') in ('', 'HISTORICAL_ONLY', 'INCLUDE_PUBLISHED_SAME_YEAR') and json_type(b, '$.referenceDataPolicy') = 'VARCHAR'"),
]


@query("with " + _rules_sql(_MULTI_SQL) + f""", asked as (select request_id, problem, case when problem is null then cast({_number('planningYear')} as integer) end y, json_extract_string(b, '$.referenceDataPolicy') pol from found),
ends as (select *, case when pol = 'INCLUDE_PUBLISHED_SAME_YEAR' and y = 1999 then y else y - 1 end last_year from asked),
first as (select min(dataset_year) f from records where quality_flag = 'VALID' and region is not null and len(type_tokens) > 0)
select request_id, case when problem is not null then 400 when coalesce(last_year >= f, false) then 200 else 422 end status, case when problem is null and not coalesce(last_year >= f, false) then 'no data' else problem end problem from ends, first""")
def checked_multi_year(spark, sf_dir):
    """A right request is refused if, under the policy that applies, no usable record is in its window.

    A window has no lower end, so it holds a record if it reaches the earliest year of all.
    """
    found = validation.multi_year(_bodies(spark, sf_dir), REGIONS, TYPES, VENUES)
    return validation.with_window(found, selection.usable(_stored(spark, sf_dir)), policy.status_table(spark)).select("request_id", "status", "problem")


_ASKED_SQL = ", ".join(_rules_sql(_MULTI_SQL).split(", bodies as", 1)[1:])
_ANSWER_SQL = f"""bodies as{_ASKED_SQL}, asked as (select request_id, problem, json_extract_string(b, '$.regionCode') q_region, cast(null as varchar) q_district, list_distinct(list_transform(json_extract(b, '$.festivalTypes[*]'), lambda t: json_extract_string(t, '$'))) q_types, json_extract_string(b, '$.venueType') q_venue,
  case when problem is null then {_number('durationDays')} end q_duration, case when problem is null then cast({_number('planningYear')} as integer) end q_planning_year, case when json_extract_string(b, '$.referenceDataPolicy') = 'INCLUDE_PUBLISHED_SAME_YEAR' then 'INCLUDE_PUBLISHED_SAME_YEAR' else 'HISTORICAL_ONLY' end q_policy from found),
q0 as (select row_number() over () query_id, * from (select distinct q_region, q_district, q_types, q_venue, q_duration, q_planning_year, q_policy from asked where problem is null))"""


@query(_sql("v1", PLAN_SQL.replace("select q.query_id,", ", pr as (select q.query_id,").replace(", " + YEARS_SQL, ", " + YEARS_SQL, 1) + """), first as (select min(dataset_year) f from r)
select request_id, case when problem is not null then 400 when coalesce(year_to >= f, false) then 200 else 422 end status, case when problem is null and not coalesce(year_to >= f, false) then 'no data' else problem end problem,
  case when year_to >= f then applied_policy end applied_policy, case when year_to >= f then sample_count end sample_count, case when year_to >= f then recommended end recommended, case when year_to >= f then p50 end p50, case when year_to >= f then reached_tier end reached_tier, case when year_to >= f then top_ids end top_ids
from asked left join q0 on asked.problem is null and q0.q_region = asked.q_region and q0.q_types = asked.q_types and q0.q_venue = asked.q_venue and q0.q_duration = asked.q_duration and q0.q_planning_year = asked.q_planning_year and q0.q_policy = asked.q_policy
left join pr on pr.query_id = q0.query_id, first""", _ANSWER_SQL))
def answered_requests(spark, sf_dir):
    """The bodies of all orders answered end to end, and what their JSON answers say."""
    index, _ = _index(spark, sf_dir)
    found = answers.multi_year(_bodies(spark, sf_dir), index, policy.status_table(spark), REGIONS, TYPES, VENUES)
    said = F.from_json("answer", "applied_policy string, sample_count long, recommended long, p50 long, reached_tier int, top_ids string")
    return found.select("request_id", "status", "problem", said.alias("a")).select("request_id", "status", "problem", "a.*")
