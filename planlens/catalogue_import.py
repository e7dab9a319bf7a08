"""Queries of the import: reports, batch headers, child rows, single-year files, names and drafts."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlens.catalogue import _canonical, query
from planlens.operators.quantiles import exact_quantiles
from planlens.sources import ingest, store
from planlens.sources.records import table
from planlens.sources.staging import folder, materialise

c = F.col

# what ``_raw`` makes of orders, once more as SQL: k = 1, 3 and 6 are fatal
GOOD_SQL = """good as (select *, cast(year(o_orderdate) as integer) y, cast(printf('%.3f', o_totalprice / 1000) as decimal(18,3))::double m, o_orderkey % 10 k from orders where o_orderkey % 10 not in (1, 3, 6))"""


REPORT_SQL = f"""with {GOOD_SQL}, every as (select *, o_orderkey % 10 k from orders), year as (select y, count(*)::double n, quantile_cont(m, 0.5) p50, quantile_cont(m, 0.25) p25, quantile_cont(m, 0.75) p75, min(m) lo, max(m) hi from good group by y),
report as (select metric, key, round(value, 4) as value from (select 'total_rows' metric, '' key, count(*)::double as value from good union all select 'missing_venue_type', '', count(*) from good union all select 'missing_cycle', '', count(*) from good union all select 'missing_duration', '', 0
union all select 'single_type_rows', '', count(*) filter (k <> 4) from good union all select 'multi_type_rows', '', count(*) filter (k = 4) from good union all select 'unknown_type_rows', '', 0 union all select 'other_type_rows', '', 0
union all select 'district_placeholders', '', count(*) from good union all select 'source_hashes', '', count(distinct o_orderkey) from good union all select 'source_sheets', '', count(distinct 's') from good union all select 'type_combinations', '', count(distinct case when k = 4 then 'A|B' end) from good
union all select 'year_first', '', min(y) from good union all select 'year_last', '', max(y) from good
union all select 'rows', cast(y as varchar), n from year union all select 'flag', 'VALID', count(*) from good union all select 'year_flag', y || ':VALID', n from year
union all select 'issues', '', count(*) from every where k between 1 and 6 union all select 'fatal_rows', '', count(*) from every where k in (1, 3, 6)
union all select 'unmapped_regions', '', count(distinct o_orderkey % 7) from every where k = 2 union all select 'unmapped_venues', '', count(distinct o_orderkey % 3) from every where k = 5
union all select 'region_value', case when k = 2 then '?' || o_orderkey % 7 else '서울' end, count(*) from every group by 2 union all select 'unmapped_region', '?' || o_orderkey % 7, count(*) from every where k = 2 group by 2
union all select 'venue_value', 'none' || o_orderkey % 3, count(*) from every where k = 5 group by 2 union all select 'unmapped_venue', 'none' || o_orderkey % 3, count(*) from every where k = 5 group by 2
union all select 'median', cast(y as varchar), p50 from year union all select 'p25', cast(y as varchar), p25 from year union all select 'p75', cast(y as varchar), p75 from year union all select 'least', cast(y as varchar), lo from year union all select 'most', cast(y as varchar), hi from year union all select 'n_budgets', cast(y as varchar), n from year))"""


@query(REPORT_SQL + " select * from report")
def import_report(spark, sf_dir):
    return ingest.import_report(_canonical(spark, sf_dir)).withColumn("value", F.round("value", 4))


EXPECT_SQL = """expected as (select 'total_rows' metric, '' key, count(*)::double expected from orders union all select 'rows', cast(year(o_orderdate) as varchar), count(*) from orders where o_orderkey % 10 not in (1, 3, 6) group by 2
union all select 'rows', '1900', 0 union all select 'flag', 'VALID', count(*) from orders where o_orderkey % 10 not in (1, 3, 6) union all select 'flag', 'UNIT_SCALE_SUSPECT', 0 union all select 'unmapped_regions', '', 0 union all select 'source_hashes', '', count(distinct o_orderkey) from orders where o_orderkey % 10 not in (1, 3, 6)
union all select 'median', cast(year(o_orderdate) as varchar), round(quantile_cont(o_totalprice / 1000, 0.5), 2) from orders where o_orderkey % 10 not in (1, 3, 6) group by 2 union all select 'median', '1900', 1)"""


def _expected(spark, sf_dir):
    """What the loaded orders should bring, from orders themselves, with some expectations that they don't meet."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("string").alias("key"), (c("o_totalprice") / 1000).alias("million"))
    good = o.where(~(c("o_orderkey") % 10).isin(1, 3, 6))
    row = lambda df, metric, key, value: df.select(F.lit(metric).alias("metric"), key.alias("key"), value.cast("double").alias("value"))
    per = good.groupBy("key").agg(F.count("*").alias("n"))
    one = good.agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("h"))
    middle = exact_quantiles(good, ["key"], "million", {"median": 0.5})
    fixed = spark.createDataFrame([("rows", "1900", 0.0), ("flag", "UNIT_SCALE_SUSPECT", 0.0), ("unmapped_regions", "", 0.0), ("median", "1900", 1.0)], "metric string, key string, value double")
    out = row(o.agg(F.count("*").alias("n")), "total_rows", F.lit(""), c("n")).union(row(per, "rows", c("key"), c("n"))).union(row(one, "flag", F.lit("VALID"), c("n"))).union(row(one, "source_hashes", F.lit(""), c("h")))
    return out.union(row(middle, "median", c("key"), F.round("median", 2))).union(fixed)


@query(REPORT_SQL + f", {EXPECT_SQL}, met as (select metric, key, expected, case when metric = 'median' then value else coalesce(value, 0) end actual from expected left join report using (metric, key)) select metric, key, expected, actual, case when metric = 'median' then coalesce(abs(expected - actual) < 0.01, false) else expected = actual end ok from met")
def import_acceptance(spark, sf_dir):
    """The report of a load against what is expected of it: the total, the unmapped regions and a median of no year fail."""
    report = ingest.import_report(_canonical(spark, sf_dir)).withColumn("value", F.round("value", 4))
    return ingest.accepted_report(report, _expected(spark, sf_dir))


@query("select y dataset_year, 's' source_sheet, cast(o_orderkey as integer) source_row, field, fatal from (select *, case when k <> 1 then cast(year(o_orderdate) as integer) end y, [{'f': 'dataset_year', 'b': true}, {'f': 'region', 'b': false}, {'f': 'festival_name', 'b': true}, {'f': 'festival_type', 'b': false}, {'f': 'venue_type', 'b': false}, {'f': 'budget_quality_flag', 'b': true}][k].f field, k in (1, 3, 6) fatal from (select *, o_orderkey % 10 k from orders) where k between 1 and 6) order by y nulls first, o_orderkey limit 30")
def issue_sample(spark, sf_dir):
    return ingest.issue_sample(_canonical(spark, sf_dir))


def _loads(spark, sf_dir):
    """A store with a load of the years up to 1996, one of all years that breaks in a task of its writing, one that the gate stops, and the first once more."""
    root, rows = folder(spark, "store"), materialise(_canonical(spark, sf_dir), "canonical")  # each load looks at its rows twice
    early = rows.where("dataset_year <= 1996")
    store.load(early, root, "early.csv", "c", "1")
    broken = rows.withColumn("period_raw", F.when(c("dataset_year") == 1998, F.raise_error(F.lit("a part is killed"))).otherwise(c("period_raw")))

    def refuse(written, seen):
        raise ValueError(f"{seen['rows']} rows are not wanted")

    for bad, gate in ((broken, None), (rows.where("dataset_year = 1997"), refuse)):
        try:
            store.load(bad, root, "late.csv", "d", "1", gate)
        except Exception as e:  # what the query shows is that nothing of these is left
            if "a part is killed" not in str(e) and "are not wanted" not in str(e):
                raise
    store.load(early, root, "again.csv", "c", "1")
    return root


@query(f"with {GOOD_SQL} select y dataset_year, count(*) records, count(distinct o_orderkey) source_rows, count(*) + count(*) filter (k = 4) types, cast(sum(count(*)) over () as bigint) total, 'early.csv' source_file_name, count(*) valid_rows from good where y <= 1996 group by y")
def store_after_failures(spark, sf_dir):
    """What is read back after a load, two that failed, and one that was there already: the first, whole, and nothing else."""
    root = _loads(spark, sf_dir)
    parents = store.records(spark, root).groupBy("dataset_year").agg(F.count("*").alias("records"), F.countDistinct("source_row").alias("source_rows"))
    children = store.types(spark, root).groupBy("dataset_year").agg(F.count("*").alias("types"))
    headers = store.batches(spark, root)
    total = headers.agg(F.sum("total_rows").alias("total"))
    return parents.join(children, "dataset_year").join(headers.select("dataset_year", "source_file_name", "valid_rows"), "dataset_year").crossJoin(F.broadcast(total)).select("dataset_year", "records", "source_rows", "types", "total", "source_file_name", "valid_rows")


@query("select year(o_orderdate)::varchar y, count(*) n, count(distinct o_orderkey) ids, count(*) filter (o_orderkey % 2 = 1) with_note, cast(round(sum(o_totalprice), 2) as decimal(18, 2))::double money from orders group by 1")
def csv_by_header(spark, sf_dir):
    """Orders written as CSV files of two kinds, with columns in another order and one more, and read back by name."""
    root = folder(spark, "csv")
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").cast("string").alias("id"), F.year("o_orderdate").cast("string").alias("y"), c("o_totalprice").cast("string").alias("money"), F.format_string('a "note", of\n%d', "o_orderkey").alias("note"), (c("o_orderkey") % 2).alias("k"))
    write = lambda df, name: df.write.option("header", True).option("escape", '"').csv(f"{root}/{name}")
    write(o.where("k = 0").select("id", "y", "money"), "even")
    write(o.where("k = 1").select("money", "note", "id", "y"), "odd")
    got = ingest.read_csv(spark, f"{root}/*", ["id", "y", "money"])
    noted = F.count_if(c("note") == F.concat(F.lit('a "note", of\n'), c("id")))
    return got.groupBy("y").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), noted.alias("with_note"), F.round(F.sum(c("money").cast("double")), 2).alias("money"))


@query(f"with {GOOD_SQL} select y dataset_year, min(sha256(cast(o_orderkey as varchar))) source_sha256, 'c' canonical_sha256, '1' importer_version, 'f.csv' source_file_name, count(*) total_rows, count(*) valid_rows, cast(0 as bigint) missing_rows, cast(0 as bigint) suspect_rows, 'SUCCESS' status from good group by y")
def batch_headers(spark, sf_dir):
    return ingest.batch_headers(ingest.accepted(_canonical(spark, sf_dir)), "f.csv", "c", "1")


@query(f"with {GOOD_SQL} select y dataset_year, \"type\", count(*) n from (select y, unnest(case when k = 4 then ['A', 'B'] else ['A'] end) as \"type\" from good) group by all")
def type_child_rows(spark, sf_dir):
    return ingest.type_rows(ingest.accepted(_canonical(spark, sf_dir)), ["dataset_year", "source_row"]).groupBy("dataset_year", "type").agg(F.count("*").alias("n"))


@query(f"with {GOOD_SQL}, h as (select y, min(sha256(cast(o_orderkey as varchar))) batch_sha256 from good where y > 1992 group by y) select y dataset_year, batch_sha256, count(*) n, min(o_orderkey) first_row from good join h using (y) group by all")
def records_with_batch(spark, sf_dir):
    """Records with the hash of their batch; those of a year that has no batch are not there."""
    good = ingest.accepted(_canonical(spark, sf_dir))
    headers = ingest.batch_headers(good, "f.csv", "c", "1").where("dataset_year > 1992")
    return ingest.with_batch(good, headers).groupBy("dataset_year", "batch_sha256").agg(F.count("*").alias("n"), F.min("source_row").cast("long").alias("first_row"))


def _cells(spark, sf_dir):
    """Orders as the cells of a single-year file."""
    o = table(spark, sf_dir, "orders").withColumn("k", c("o_orderkey") % 10)
    no = F.lit(None)
    day = lambda x: [F.year(x), F.month(x), F.dayofmonth(x)]
    start, end = day("o_orderdate"), day(F.date_add("o_orderdate", (c("k") - 3).cast("int")))
    return o.select(
        c("o_orderkey").alias("row"), F.when(c("k") == 1, " ").otherwise(" n ").alias("festival_name"), F.when(c("k") == 2, "9. ?").otherwise("1. 서울").alias("region"), F.when(c("k") == 3, "-").otherwise("x").alias("district"), F.lit("2. 문화예술").alias("festival_type"), F.lit("마을형").alias("venue_type"), F.lit("1. 매년").alias("cycle"),
        F.when(c("k") == 0, 2.5).alias("duration_number"), *(x.alias(n) for n, x in zip(("start_year", "start_month", "start_day", "end_year", "end_month", "end_day"), start + end, strict=True)),
        F.when(c("k") < 7, F.when(c("k") == 6, 0.0).otherwise(c("o_totalprice") / 1000)).alias("budget_number"), F.when(c("k") == 7, "미확정").when(c("k") == 8, "x").otherwise(no.cast("string")).alias("budget"), F.when(c("k") < 5, c("o_totalprice")).alias("visitors_number"), F.when(c("k") == 5, "최초 개최").when(c("k") == 6, "?").otherwise(no.cast("string")).alias("visitors"),
    )


@query("with s as (select *, case when o_orderkey % 6007 <> 6006 then o_totalprice end serial from orders where o_orderkey >= 8), e as (select min(o_orderkey) e from s where serial is null) select year(o_orderdate) y, count(*) n, max(o_orderkey) last_row, cast(round(sum(serial), 2) as decimal(18, 2))::double serials from s, e where e is null or o_orderkey < e group by all")
def sheet_until_empty(spark, sf_dir):
    """Orders as the rows of a sheet in the order of their keys, whose data ends at the first row without a serial."""
    cells = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("row"), F.year("o_orderdate").alias("y"), F.when(c("o_orderkey") % 6007 != 6006, c("o_totalprice")).alias("serial"))
    return ingest.until_empty(cells, "row", "serial").groupBy("y").agg(F.count("*").alias("n"), F.max("row").alias("last_row"), F.round(F.sum("serial"), 2).alias("serials"))


@query("""select array_to_string(case k when 1 then ['festival_name'] when 2 then ['region'] else [] end, ',') missing, case when k <> 3 then 'x' end district, case when k = 0 then 3 when k > 2 then k - 2 end duration_days, case when k = 0 then 'REPORTED' when k > 2 then 'CALCULATED' else 'UNKNOWN' end duration_source,
case when k < 6 then 'CONFIRMED' when k = 6 then 'ZERO' when k = 7 then 'UNCONFIRMED' else 'NO_RESPONSE' end budget_status, case when k = 5 then 'FIRST_TIME_HELD' end visitors_status, count(*) n, sum(case when k < 7 then case when k = 6 then 0 else cast(floor(o_totalprice / 1000 * 1000000 + 0.5) as bigint) end end)::bigint krw, sum(case when k < 5 then cast(floor(o_totalprice + 0.5) as bigint) end)::bigint visitors
from (select *, cast(o_orderkey % 10 as integer) k from orders) group by all""")
def single_year_import(spark, sf_dir):
    got = ingest.single_year(_cells(spark, sf_dir), {"서울": "SEOUL"}, {"문화예술": "CULTURE_ART"}, {"마을형": "VILLAGE"})
    return got.groupBy(F.array_join("missing", ",").alias("missing"), "district", "duration_days", "duration_source", "budget_status", "visitors_status").agg(F.count("*").alias("n"), F.sum("budget_krw").alias("krw"), F.sum("visitors").alias("visitors"))


@query("select nfc_normalize('e' || chr(769) || chr(4370) || chr(4449) || chr(4523) || p_name) as \"name\", count(*) n from part group by all")
def composed_names(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(ingest.composed(F.concat(F.lit("é한"), "p_name")).alias("name")).agg(F.count("*").alias("n"))


DRAFTS = [
    ('{"concept": "c", "programIdeas": ["a", 1, null, "b"], "differentiationPoints": "x", "cautions": []}', "c", "a|b", "", ""),
    ('{"concept": 3, "cautions": ["z"]}', "", "", "", "z"),
    ("{", None, None, None, None),
    ("{}", "", "", "", ""),
]


@query("select * from (values " + ", ".join("(" + ", ".join([str(i), *("null" if x is None else f"'{x}'" for x in r[1:])]) + ")" for i, r in enumerate(DRAFTS)) + ") t(id, concept, ideas, points, cautions)")
def plan_drafts(spark, sf_dir):
    got = spark.createDataFrame([(i, r[0]) for i, r in enumerate(DRAFTS)], "id int, body string").withColumn("d", ingest.plan_draft(c("body")))
    return got.select("id", "d.concept", F.array_join("d.programIdeas", "|").alias("ideas"), F.array_join("d.differentiationPoints", "|").alias("points"), F.array_join("d.cautions", "|").alias("cautions"))


@query(f"with {GOOD_SQL} select y dataset_year, '-' district, array_to_string(['A'], '|') types, count(*) n, sum(cast(m * 1000000 as bigint))::double krw from good group by y")
def working_rows(spark, sf_dir):
    got = ingest.loaded(ingest.accepted(_canonical(spark, sf_dir)), ["A", "C"])
    return got.groupBy("dataset_year", "district", F.array_join("type_tokens", "|").alias("types")).agg(F.count("*").alias("n"), F.sum("budget_krw").alias("krw"))


@query("select * from (values ('b.csv', 'h2'), ('c.csv', 'h3')) t(path, sha256)")
def file_idempotency(spark, sf_dir):
    """Of four files the two whose content is new; a copy under another name is not."""
    files = spark.createDataFrame([("a.csv", "h1"), ("a copy.csv", "h1"), ("b.csv", "h2"), ("c.csv", "h3")], "path string, sha256 string")
    return ingest.new_files(files, spark.createDataFrame([("old.csv", "h1")], files.schema)).select("path", "sha256")
