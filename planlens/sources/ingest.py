"""Reading, canonicalising, profiling and accepting raw plan rows, and writing them once."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from planlens.operators.quantiles import exact_quantiles, quantiles_of, slice_of, wanted_slices
from planlens.sources import csvfiles
from planlens.sources.staging import materialise

c = F.col

# The header and the code lists of the raw files.
HEADERS = (
    "dataset_year",
    "source_sheet",
    "source_row",
    "source_sha256",
    "region_raw",
    "region",
    "district_raw",
    "district",
    "festival_name",
    "festival_type_raw",
    "festival_type",
    "venue_raw",
    "venue_type_raw",
    "venue_type",
    "period_raw",
    "duration_days",
    "duration_source",
    "duration_note_raw",
    "cycle",
    "event_mode",
    "event_status",
    "covid_affected",
    "first_held_year",
    "budget_total_raw",
    "budget_total_million",
    "budget_national_million",
    "budget_local_million",
    "budget_other_million",
    "budget_quality_flag",
    "budget_quality_note",
    "visitor_total_persons",
)
FATAL_FIELDS = ("dataset_year", "source_sheet", "source_row", "source_sha256", "festival_name", "budget_quality_flag")
QUALITY_FLAGS = ("VALID", "MISSING_OR_NONPOSITIVE", "UNIT_SCALE_SUSPECT")
DURATION_SOURCES = ("EXPLICIT_TEXT", "SOURCE_TOTAL_DAYS", "UNPARSED")
CYCLES = {"매년": "ANNUAL", "격년": "BIENNIAL", "일회성": "ONE_TIME", "최초": "FIRST_TIME"}
VISITOR_STATUS = {"미집계": "NOT_TALLIED", "최초 개최": "FIRST_TIME_HELD", "최근 미개최": "RECENTLY_NOT_HELD", "모름": "UNKNOWN"}
#: No districts; only whole values count, so "시" leaves "수원시" alone.
DISTRICT_PLACEHOLDERS = ("-", "시자체", "본청", "도", "시", "지자체", "도자체", "시 자체", "미기재", "서울시", "울산시", "제주도", "세종시", "제주도 본청", "대구광역시")


def read_csv(spark: SparkSession, path: str, headers: tuple[str, ...] | list[str] = HEADERS, corrupt: str | None = None) -> DataFrame:
    """All columns as strings, by the header names of each file; see ``csvfiles``."""
    return csvfiles.read_csv(spark, path, headers, corrupt)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path and sha256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def latest_file(paths: DataFrame) -> DataFrame:
    """The path with the greatest year in its name, as in ``2026년``, whether that is composed or not."""
    year = F.regexp_extract(composed(c("path")), r"(?U)((?:19|20)[0-9]{2})\s*년", 1)
    return paths.where(year != "").agg(F.max_by("path", F.struct(year, "path")).alias("path"))


def trim_to_null(x: Column) -> Column:
    """Unicode white space at the ends goes; nothing left is null."""
    return F.nullif(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), F.lit(""))


def dash_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit("-"))


def strip_prefix(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^[0-9]{1,2}\.\s*", "")


def mapped(x: Column, codes: dict[str, str]) -> Column:
    """The code of a label, null where there is none."""
    return F.element_at(F.create_map(*(F.lit(v) for kv in codes.items() for v in kv)), x) if codes else F.lit(None).cast("string")


def parse_types(x: Column, known: list[str]) -> tuple[Column, Column]:
    """The known and the unknown tokens of a list separated by bars, first ones kept, blanks dropped."""
    parts = F.array_distinct(F.array_compact(F.transform(F.split(F.coalesce(x, F.lit("")), r"\|"), lambda t: trim_to_null(t))))
    codes = F.array(*map(F.lit, known))
    return F.filter(parts, lambda t: F.array_contains(codes, t)), F.filter(parts, lambda t: ~F.array_contains(codes, t))


def parse_boolean(x: Column) -> Column:
    return F.coalesce(F.lower(x) == "true", F.lit(False))


def to_int(x: Column) -> Column:
    """Rounded half up; null if it is no finite number."""
    d = x.try_cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < 9e15), F.floor(d + 0.5).cast("long"))


def million_to_krw(x: Column) -> Column:
    """Exact: three decimals times a million."""
    return (x.cast("decimal(18,3)") * 1_000_000).cast("bigint")


def budget_to_krw(million: Column) -> Column:
    """Of a number in floating point, as single-year files have it: rounded half up after the product."""
    return F.when(million.isNotNull(), F.floor(million * 1_000_000 + 0.5).cast("bigint"))


def visitors(number: Column, text: Column) -> tuple[Column, Column]:
    """The count if the cell is a number, else the status that its text names, if any."""
    return F.when(number.isNotNull(), F.floor(number + 0.5).cast("bigint")), F.when(number.isNull(), mapped(text, VISITOR_STATUS))


@F.pandas_udf(StringType())
def _composed(x: pd.Series) -> pd.Series:
    return x.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def composed(x: Column) -> Column:
    """Names as composed (NFC) text, once at ingest; Spark has no function of its own for it."""
    return _composed(x)


def until_empty(cells: DataFrame, row: str, serial: str, first: int = 8) -> DataFrame:
    """The rows of a sheet from ``first`` up to the first one without a serial number, where the data ends whatever follows.

    That row is the least of all that lack one, a minimum that is combined where the rows are; no task sees the sheet in order.
    """
    data = cells.where(c(row) >= first)
    end = data.where(c(serial).isNull()).agg(F.min(row).alias("__end"))
    return data.crossJoin(F.broadcast(end)).where(c("__end").isNull() | (c(row) < c("__end"))).drop("__end")


def single_year(raw: DataFrame, regions: dict[str, str], types: dict[str, str], venues: dict[str, str]) -> DataFrame:
    """The records of a single-year file with ``missing``, the required fields that a row lacks; only rows that lack none are loaded.

    A cell of the file is a text column, and for numbers also a double column of the same name with ``_number`` after it.
    """
    code = lambda n, codes: mapped(strip_prefix(c(n)), codes)
    days, source = duration(F.floor(c("duration_number") + 0.5).cast("int"), rolled_date(c("start_year"), c("start_month"), c("start_day")), rolled_date(c("end_year"), c("end_month"), c("end_day")))
    seen, status = visitors(c("visitors_number"), trim_to_null(c("visitors")))
    df = raw.select(
        "row", composed(trim_to_null(c("festival_name"))).alias("festival_name"), code("region", regions).alias("region"), dash_to_null(c("district")).alias("district"), code("festival_type", types).alias("festival_type"), code("venue_type", venues).alias("venue_type"),
        code("cycle", CYCLES).alias("cycle_type"), days.alias("duration_days"), source.alias("duration_source"), budget_to_krw(c("budget_number")).alias("budget_krw"), budget_status(c("budget_number"), trim_to_null(c("budget"))).alias("budget_status"), seen.alias("visitors"), status.alias("visitors_status"),
    )
    required = ("festival_name", "region", "festival_type", "venue_type", "cycle_type")
    return df.withColumn("missing", F.array_compact(F.array(*(F.when(c(n).isNull(), n) for n in required))))


def plan_draft(body: Column) -> Column:
    """concept, programIdeas, differentiationPoints and cautions of a drafted plan in JSON: what is not a text is empty, lists keep their texts; null if it is no JSON."""
    v = F.try_parse_json(body)
    kind = lambda x: F.schema_of_variant(x)
    concept = F.try_variant_get(v, "$.concept", "variant")
    strings = lambda n: F.coalesce(F.transform(F.filter(F.try_variant_get(v, f"$.{n}", "array<variant>"), lambda x: kind(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>")).alias(n)
    shape = F.struct(F.when(kind(concept) == "STRING", F.try_variant_get(v, "$.concept", "string")).otherwise("").alias("concept"), *(strings(n) for n in ("programIdeas", "differentiationPoints", "cautions")))
    return F.when(v.isNotNull(), shape)


def budget_status(number: Column, text: Column) -> Column:
    return F.when(number > 0, "CONFIRMED").when(number.isNotNull(), "ZERO").when(text == "미확정", "UNCONFIRMED").otherwise("NO_RESPONSE")


def rolled_date(year: Column, month: Column, day: Column) -> Column:
    """A date whose month and day may run over, as February 30 is March 1 or 2."""
    return F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1), day - 1)


def duration(reported: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Days and where they come from: reported, else end - start + 1 if positive."""
    days = F.datediff(end, start) + 1
    return F.coalesce(reported, F.when(days > 0, days)), F.when(reported.isNotNull(), "REPORTED").when(days > 0, "CALCULATED").otherwise("UNKNOWN")


def canonical(raw: DataFrame, regions: dict[str, str], types: list[str], venues: dict[str, str]) -> DataFrame:
    """The canonical row with ``issues``, an array of (field, fatal); rows with a fatal issue must not be written."""
    own = lambda n: c(n) if n in raw.columns else F.lit(None).cast("string")
    get = lambda n: trim_to_null(own(n))
    known, unknown = parse_types(c("festival_type"), types)
    flag = get("budget_quality_flag")
    venue, district, source = get("venue_type"), get("district_raw"), get("duration_source")
    million = lambda n: get(n).try_cast("decimal(18,3)").alias(n)
    df = raw.select(
        to_int(get("dataset_year")).cast("int").alias("dataset_year"), get("source_sheet").alias("source_sheet"), to_int(get("source_row")).cast("int").alias("source_row"), get("source_sha256").alias("source_sha256"),
        F.coalesce(get("region_raw"), F.lit("")).alias("region_raw"), mapped(get("region"), regions).alias("region"), own("region").alias("region_value"), own("venue_type").alias("venue_value"), (own("region").isNotNull() & mapped(get("region"), regions).isNull()).alias("region_unmapped"), district.alias("district_raw"), F.when(~district.isin(*DISTRICT_PLACEHOLDERS), district).alias("district"), composed(get("festival_name")).alias("festival_name"),
        known.alias("type_tokens"), unknown.alias("unknown_types"), mapped(venue, venues).alias("venue_type"), (venue.isNotNull() & mapped(venue, venues).isNull()).alias("venue_unmapped"), (get("festival_type").isNotNull() & (F.size(known) == 0)).alias("no_known_type"),
        to_int(get("duration_days")).cast("int").alias("duration_days"), parse_boolean(get("covid_affected")).alias("covid_affected"), get("budget_total_million").try_cast("decimal(18,3)").alias("budget_total_million"),
        F.when(flag.isin(*QUALITY_FLAGS), flag).alias("quality_flag"),
        *(get(n).alias(n) for n in ("festival_type_raw", "venue_raw", "venue_type_raw", "period_raw", "duration_source", "duration_note_raw", "event_mode", "event_status", "budget_quality_note")),
        get("cycle").alias("cycle_raw"), mapped(get("cycle"), CYCLES).alias("cycle_type"), to_int(get("first_held_year")).alias("first_held_year"), to_int(get("visitor_total_persons")).alias("visitor_total_persons"), own("budget_total_raw").alias("budget_total_raw"),
        million("budget_national_million"), million("budget_local_million"), million("budget_other_million"), (source.isNotNull() & ~source.isin(*DURATION_SOURCES)).alias("duration_source_unknown"),
    )
    df = df.withColumn("budget_krw", million_to_krw(c("budget_total_million")))
    issue = lambda cond, field, bad: F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(bad).alias("fatal")))
    found = [issue(c(f.removeprefix("budget_")).isNull(), f, True) for f in FATAL_FIELDS]
    found += [issue(c("region_unmapped"), "region", False), issue(c("venue_unmapped"), "venue_type", False), issue(F.size("unknown_types") > 0, "festival_type", False), issue(c("no_known_type"), "festival_type", False), issue(c("duration_source_unknown"), "duration_source", False)]
    return df.withColumn("issues", F.array_compact(F.array(*found)))


def accepted(rows: DataFrame) -> DataFrame:
    """Canonical rows without a fatal issue."""
    return rows.where(~_fatal())


#: What the rows of a load are counted by, each in a grouping set of its own.
COUNTED = ("year_flag", "million", "source_sha256", "source_sheet", "type_combination", "region_value", "venue_value", "unmapped_region", "unmapped_venue")


def _fatal() -> Column:
    return F.exists("issues", lambda i: i["fatal"])


def _row_counts() -> dict[str, Column]:
    return {
        "missing_venue_type": c("venue_type").isNull(), "missing_cycle": c("cycle_raw").isNull(), "missing_duration": c("duration_days").isNull(), "single_type_rows": F.size("type_tokens") == 1, "multi_type_rows": F.size("type_tokens") > 1,
        "unknown_type_rows": F.array_contains("type_tokens", "UNKNOWN"), "other_type_rows": F.array_contains("type_tokens", "OTHER"), "district_placeholders": c("district_raw").isNotNull() & c("district").isNull(), "issues": F.size("issues"),
    }


def counted(rows: DataFrame) -> DataFrame:
    """good, by, dataset_year, key, number, k and the sums of ``_row_counts``: all that a report is made of, in one pass over canonical rows.

    Each of COUNTED is a grouping set beside good (no fatal issue). Values are combined where the rows are, so what is shuffled are
    distinct values; budgets (number) are counted by year and value.
    """
    valid = F.when(~_fatal() & (c("quality_flag") == "VALID"), c("budget_total_million").cast("double"))
    entry = lambda year=None, key=None, number=None: F.struct((F.lit(None).cast("int") if year is None else year).alias("dataset_year"), (F.lit(None).cast("string") if key is None else key).alias("key"), (F.lit(None).cast("double") if number is None else number).alias("number"))
    keys = {"year_flag": entry(c("dataset_year"), c("quality_flag")), "million": F.when(valid.isNotNull(), entry(c("dataset_year"), F.lit(""), valid))}
    combination = F.when(F.size("type_tokens") > 1, F.array_join(F.array_sort("type_tokens"), "|"))
    texts = {"source_sha256": c("source_sha256"), "source_sheet": c("source_sheet"), "type_combination": combination, "region_value": c("region_value"), "venue_value": c("venue_value"), "unmapped_region": F.when(c("region_unmapped"), c("region_value")), "unmapped_venue": F.when(c("venue_unmapped"), c("venue_value"))}
    keys |= {n: F.when(v.isNotNull(), entry(key=v)) for n, v in texts.items()}
    counts, names = _row_counts(), [f"by_{n}" for n in COUNTED]
    marked = rows.select((~_fatal()).alias("good"), *(keys[n].alias(f"by_{n}") for n in COUNTED), *(v.cast("long").alias(n) for n, v in counts.items()))
    found = marked.groupingSets([["good", n] for n in names], "good", *names).agg(F.count("*").alias("k"), *(F.sum(n).alias(n) for n in counts), F.grouping_id().alias("g"))
    # a set's id has a bit for each column but good and its own, the first column's highest
    ids = {(1 << len(names)) - 1 - (1 << (len(names) - 1 - i)): n for i, n in enumerate(COUNTED)}
    by = F.element_at(F.create_map(*(F.lit(x) for pair in ids.items() for x in pair)), c("g").cast("int"))
    return found.withColumn("by", by).withColumn("x", F.coalesce(*names)).where("x is not null").select("good", "by", "x.dataset_year", "x.key", "x.number", "k", *counts)


def import_report(rows: DataFrame) -> DataFrame:
    """metric, key, value: what a load would bring, from one pass over canonical rows. Counts are of the rows without a fatal issue, but for
    those of issues, skipped rows, and values as they were read (region_value, venue_value, and what no code is known for)."""
    table = materialise(counted(rows), "counted")
    good, flags = table.where("good"), table.where("by = 'year_flag'")
    flat = lambda metric, key, value: (F.lit(metric).alias("metric"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    none = F.lit("")
    kinds = {"source_hashes": "source_sha256", "source_sheets": "source_sheet", "type_combinations": "type_combination"}
    ones = {"total_rows": F.sum(F.when(c("good"), c("k"))), "fatal_rows": F.sum(F.when(~c("good"), c("k"))), "issues": F.sum("issues")} | {n: F.sum(F.when(c("good"), c(n))) for n in _row_counts() if n != "issues"}
    ones |= {"year_first": F.min(F.when(c("good"), c("dataset_year"))), "year_last": F.max(F.when(c("good"), c("dataset_year")))}
    zero = lambda n, v: (v if n.startswith("year_") else F.coalesce(v, F.lit(0))).cast("double").alias(n)
    one = flags.agg(*(zero(n, v) for n, v in ones.items())).unpivot([], list(ones), "metric", "value").select("metric", none.alias("key"), "value").where("value is not null")
    distinct = table.agg(*(F.count_if(c("good") & (c("by") == v)).cast("double").alias(n) for n, v in kinds.items()), *(F.size(F.collect_set(F.when(c("by") == v, c("key")))).cast("double").alias(n) for n, v in {"unmapped_regions": "unmapped_region", "unmapped_venues": "unmapped_venue"}.items()))
    distinct = distinct.unpivot([], distinct.columns, "metric", "value").select("metric", none.alias("key"), "value")
    years = good.where("by = 'year_flag'")
    by_year = years.groupBy("dataset_year").agg(F.sum("k").alias("k")).select(*flat("rows", c("dataset_year"), c("k")))
    by_flag = years.groupBy("key").agg(F.sum("k").alias("k")).select(*flat("flag", c("key"), c("k")))
    by_both = years.select(*flat("year_flag", F.concat_ws(":", c("dataset_year").cast("string"), "key"), c("k")))
    values = table.where(c("by").isin("region_value", "venue_value", "unmapped_region", "unmapped_venue")).groupBy("by", "key").agg(F.sum("k").alias("k")).select(c("by").alias("metric"), "key", c("k").cast("double").alias("value"))
    money = good.where("by = 'million'").select("dataset_year", c("number").alias("v"), "k").withColumn("slice", slice_of(c("v")))
    ps = {"median": 0.5, "p25": 0.25, "p75": 0.75}
    wanted = wanted_slices(money.groupBy("dataset_year", "slice").agg(F.sum("k").alias("k")), ["dataset_year"], ps)
    middle = quantiles_of(money.join(wanted, ["dataset_year", "slice"]), ["dataset_year"], ps, number=F.sum("k"))
    ends = money.groupBy("dataset_year").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.sum("k").cast("double").alias("n_budgets"))
    sane = middle.drop("n").join(ends, "dataset_year").unpivot(["dataset_year"], [*ps, "least", "most", "n_budgets"], "metric", "value").select("metric", c("dataset_year").cast("string").alias("key"), "value")
    return one.union(distinct).union(by_year).union(by_flag).union(by_both).union(values).union(sane)


# What the data set of 2017 to 2026 holds.
EXPECTED_ROWS = {2017: 733, 2018: 886, 2019: 884, 2020: 968, 2021: 1004, 2022: 944, 2023: 1129, 2024: 1170, 2025: 1214, 2026: 1266}
EXPECTED_MEDIANS = {2017: 200, 2018: 200, 2019: 200, 2020: 198, 2021: 166.4, 2022: 170, 2023: 196, 2024: 200, 2025: 200, 2026: 204.5}
EXPECTED_FLAGS = {"VALID": 9930, "MISSING_OR_NONPOSITIVE": 258, "UNIT_SCALE_SUSPECT": 10}
EXPECTED_ONES = {"total_rows": 10198, "multi_type_rows": 152, "source_hashes": 10, "unmapped_regions": 0, "issues": 0, "fatal_rows": 0}


def expectations(spark: SparkSession) -> DataFrame:
    """metric, key, value: all that the data set of 2017 to 2026 must have."""
    rows = [(m, "", float(v)) for m, v in EXPECTED_ONES.items()] + [("flag", k, float(v)) for k, v in EXPECTED_FLAGS.items()]
    rows += [(m, str(y), float(v)) for m, of in (("rows", EXPECTED_ROWS), ("median", EXPECTED_MEDIANS)) for y, v in of.items()]
    return spark.createDataFrame(rows, "metric string, key string, value double")


def accepted_report(report: DataFrame, expected: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """metric, key, expected, actual, ok for each expectation: counts must be equal, and are 0 where the report has none; medians must be there and less than ``tolerance`` apart."""
    both = expected.withColumnRenamed("value", "expected").join(report.withColumnRenamed("value", "actual"), ["metric", "key"], "left")
    median = c("metric") == "median"
    both = both.withColumn("actual", F.when(median, c("actual")).otherwise(F.coalesce("actual", F.lit(0.0))))
    return both.withColumn("ok", F.when(median, F.coalesce(F.abs(c("expected") - c("actual")) < tolerance, F.lit(False))).otherwise(c("expected") == c("actual")))


def issue_sample(rows: DataFrame, n: int = 30) -> DataFrame:
    """The first ``n`` issues in the order of the rows."""
    listed = rows.select("dataset_year", "source_sheet", "source_row", F.posexplode("issues").alias("place", "issue"))
    order = [c(x).asc_nulls_first() for x in ("dataset_year", "source_sheet", "source_row", "place")]
    return listed.orderBy(*order).limit(n).select("dataset_year", "source_sheet", "source_row", "issue.field", "issue.fatal")


def profile(records: DataFrame) -> DataFrame:
    """Per year: rows, rows by quality flag, missing features, single and multiple types, and the budgets of valid rows."""
    valid = F.when(c("quality_flag") == "VALID", c("budget_krw"))
    counts = records.groupBy("dataset_year").agg(
        F.count("*").alias("n"), F.count_if(c("quality_flag") == "VALID").alias("n_valid"), F.count_if(c("quality_flag") != "VALID").alias("n_not_valid"), F.count_if(c("duration_days").isNull()).alias("no_duration"),
        F.count_if(F.size("type_tokens") == 0).alias("no_type"), F.count_if(F.size("type_tokens") == 1).alias("single_type"), F.count_if(F.size("type_tokens") > 1).alias("multi_type"),
        F.countDistinct("region").alias("regions"), F.min(valid).alias("least"), F.max(valid).alias("most"),
    )
    middle = exact_quantiles(records.select("dataset_year", valid.alias("valid")), ["dataset_year"], "valid", {"median": 0.5, "p25": 0.25, "p75": 0.75}).drop("n")
    return counts.join(middle, "dataset_year", "left")


def acceptance(actual: DataFrame, expected: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """metric, expected, actual, ok over (metric, value) tables: less than ``tolerance`` apart. A metric on one side only fails."""
    both = expected.select("metric", c("value").alias("expected")).join(actual.select("metric", c("value").alias("actual")), "metric", "full_outer")
    return both.withColumn("ok", F.coalesce(F.abs(c("expected") - c("actual")) < tolerance, F.lit(False)))


def accept(report: DataFrame) -> None:
    """Stops a load whose report has a failure."""
    bad = report.where("not ok").limit(20).collect()
    if bad:
        raise ValueError("not accepted: " + "; ".join(f"{r.metric}: expected {r.expected}, got {r.actual}" for r in bad))


BATCH_KEY = ["dataset_year", "source_sha256", "canonical_sha256", "importer_version"]


def batch_headers(rows: DataFrame, file_name: str, canonical_sha256: str, importer_version: str) -> DataFrame:
    """One header for each year: its key, the file, and how many rows of each quality it brings."""
    flags = {"valid_rows": "VALID", "missing_rows": "MISSING_OR_NONPOSITIVE", "suspect_rows": "UNIT_SCALE_SUSPECT"}
    return rows.groupBy("dataset_year").agg(
        F.min("source_sha256").alias("source_sha256"), F.lit(canonical_sha256).alias("canonical_sha256"), F.lit(importer_version).alias("importer_version"), F.lit(file_name).alias("source_file_name"),
        F.count("*").alias("total_rows"), *(F.count_if(c("quality_flag") == v).alias(k) for k, v in flags.items()), F.lit("SUCCESS").alias("status"),
    )


def type_rows(rows: DataFrame, key: list[str]) -> DataFrame:
    """The child rows: ``key`` and one type each; a row without a type has none."""
    return rows.select(*key, F.explode("type_tokens").alias("type"))


def with_batch(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """The rows with the hash of the file that their year's batch came from; a row whose year has no header is not loaded yet."""
    return rows.join(headers.select("dataset_year", c("source_sha256").alias("batch_sha256")), "dataset_year")


def new_files(files: DataFrame, existing: DataFrame) -> DataFrame:
    """The files (path, sha256) whose content was not loaded before, under whatever name."""
    return files.join(existing.select("sha256"), "sha256", "left_anti")


def loaded(rows: DataFrame, types: list[str]) -> DataFrame:
    """The working rows that estimates read, from canonical ones: the district as it was given, only ``types`` among the types, and 0 for a missing budget."""
    known = F.array_intersect("type_tokens", F.array(*map(F.lit, types)))
    return rows.withColumn("district", trim_to_null(c("district_raw"))).withColumn("type_tokens", known).withColumn("budget_krw", F.coalesce("budget_krw", F.lit(0).cast("long")).cast("double"))


def golden(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Expected rows from a CSV file, by header name and cast to ``schema``; an empty cell is null."""
    fields = StructType.fromDDL(schema)
    raw = read_csv(spark, path, [f.name for f in fields])
    return raw.select(*(trim_to_null(c(f.name)).try_cast(f.dataType).alias(f.name) for f in fields))


def new_batches(batches: DataFrame, existing: DataFrame) -> DataFrame:
    """Those not loaded before; their key is the year, both hashes and the importer's version."""
    return batches.join(existing, BATCH_KEY, "left_anti")


def write_records(records: DataFrame, path: str) -> None:
    """One folder per year; a year that is written again replaces what was there."""
    spark = records.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        records.hint("rebalance", "dataset_year").write.mode("overwrite").partitionBy("dataset_year").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
