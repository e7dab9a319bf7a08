"""Planning analytics: keywords, whitespace, months, cost per visitor and recommendation cards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from planlens.functions.labels import REGIONS, TYPES, VENUES, label
from planlens.functions.scoring import UNDECIDED, half_up
from planlens.operators.quantiles import exact_quantiles

c = F.col

# What is taken out of names, what is no keyword, and where names are split.
GENERIC_TERMS = ("대축제", "축제", "페스티벌", "페스타", "축전", "문화제", "예술제", "한마당", "대잔치", "잔치", "행사", "기념행사", "주간", "위크", "엑스포", "박람회", "festival", "FESTIVAL", "Festival", "fest", "FEST")
STOP_TOKENS = ("제", "년", "회", "차", "및", "그리고", "with", "and", "the", "in", "of", "시", "군", "구", "도", "읍", "면", "동", "리", "전국", "지역", "전통", "문화", "관광", "시민", "군민", "구민", "도민", "주민", "가족", "어린이", "청소년", "국제", "세계", "한국", "대한민국", "제일", "최대", "봄", "여름", "가을", "겨울")
VERBAL_ENDINGS = ("하는", "있는", "없는", "되는", "지는", "치는", "리는")
REGION_SUFFIXES = ("특별자치도", "특별자치시", "특별시", "광역시", "도", "시")
PAREN = r"[（(\[{][^）)\]}]*[）)\]}]"
ORDINAL = r"(?U)제?\s*[0-9]+\s*(회|주년|차|번째)"
YEAR = r"(?U)(19|20)[0-9]{2}\s*년?"
#: Names of places that may be taken out of names.
MAX_TERMS = 100_000
SPLIT = r"(?U)[\s·・,./&\-–—~!?:;\"'「」『』<>＜＞|+*]+"


def removal_terms(regions: list[str], districts: list[str]) -> list[str]:
    """Everything taken out of a name, longest first: districts with and without their suffix, regions with each, generic terms."""
    out: list[str] = []
    for d in districts:
        if len(d) >= 2:
            out += [d] + ([d[:-1]] if d[-1] in "시군구" and len(d) > 2 else [])
    out = list(dict.fromkeys(out))
    for r in regions:
        out += [r, *(r + s for s in REGION_SUFFIXES)]
    return sorted([*out, *GENERIC_TERMS], key=len, reverse=True)


def corpus_terms(records: DataFrame, regions: list[str] | None = None) -> list[str]:
    """``removal_terms`` of the districts that the records name, and of ``regions`` or those that they name.

    Names of places are few whatever the number of records; more than MAX_TERMS are refused, as every task holds them.
    """
    found = records.select(F.explode(F.array(F.struct(F.lit("d").alias("k"), c("district").alias("v")), F.struct(F.lit("r").alias("k"), c("region").alias("v")))).alias("x")).select("x.*").where("v <> ''").distinct().limit(MAX_TERMS + 1).collect()
    if len(found) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} names of places")
    districts, own = (sorted(r["v"] for r in found if r["k"] == k) for k in "dr")
    return removal_terms(own if regions is None else regions, districts)


def removed(name: str, places: dict[str, int], lengths: list[int], late: list[str]) -> str:
    """What replacing each term by a space, one after the other in their order, leaves of a name, in one walk over it.

    All places where a term stands are found by looking substrings up; they are taken in the order of the terms, then from the
    left, unless a letter is taken already. ``late`` are terms with a blank and all after them: these could match a blank that a
    removal leaves, and are replaced one by one.
    """
    found = sorted((rank, i, n) for n in lengths for i in range(len(name) - n + 1) if (rank := places.get(name[i : i + n])) is not None)
    if found:
        taken = bytearray(len(name))
        starts = set()
        for _, i, n in found:
            if not any(taken[i : i + n]):
                taken[i : i + n] = b"\x01" * n
                starts.add(i)
        name = "".join(" " if i in starts else "" if taken[i] else ch for i, ch in enumerate(name))
    for t in late:
        name = name.replace(t, " ")
    return name


def without_terms(name: Column, removals: list[str]) -> Column:
    """A name without the terms. However many there are, a name is walked once."""
    terms = list(dict.fromkeys(removals))
    cut = next((i for i, t in enumerate(terms) if " " in t), len(terms))
    places = {t: i for i, t in enumerate(terms[:cut])}
    lengths, late = sorted(set(map(len, places))), terms[cut:]

    @F.pandas_udf(StringType())
    def walk(x: pd.Series) -> pd.Series:
        return x.map(lambda s: removed(s, places, lengths, late), na_action="ignore")

    return walk(name)


def tokens(name: Column, removals: list[str]) -> Column:
    """The keyword candidates of a name. Terms are taken out in their order, as that is not the same as one alternation.

    Names are taken as composed (NFC) text; ``ingest.composed`` makes them so.
    """
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, PAREN, " "), ORDINAL, " "), YEAR, " ")
    s = without_terms(s, removals) if removals else s
    parts = F.transform(F.split(s, SPLIT), lambda t: F.when((F.length(t) >= 3) & t.endswith("제"), F.regexp_replace(t, "제$", "")).otherwise(t))
    keep = lambda t: (F.length(t) >= 2) & (F.length(t) <= 8) & t.rlike("[가-힣a-zA-Z0-9]") & ~t.isin(*STOP_TOKENS) & ~t.rlike(f"({'|'.join(VERBAL_ENDINGS)})$") & ~t.rlike("^[0-9]+$")
    return F.filter(parts, keep)


def districts_by_region(records: DataFrame) -> DataFrame:
    """region, districts: the names of each region in order; records without one, or with an empty one, don't count."""
    return records.where("district <> ''").groupBy("region").agg(F.sort_array(F.collect_set("district")).alias("districts"))


def vocabulary(names: DataFrame, least: int = 2) -> DataFrame:
    """token, df, first_seen: tokens of at least ``least`` names, each name counted once; first_seen is the smallest id."""
    each = names.select("id", F.explode(F.array_distinct("tokens")).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("df"), F.min("id").alias("first_seen")).where(c("df") >= least)


def keywords(names: DataFrame, vocab: DataFrame) -> DataFrame:
    """id, keyword: a token that is in the vocabulary is itself; of another token every shorter entry that it contains.

    Containment needs no join of all with all: a token has at most 8 letters and so at most 26 substrings of 2 to 7
    letters, each of which meets the vocabulary by equality.
    """
    each = names.select("id", F.explode(F.array_distinct("tokens")).alias("token"))
    words = vocab.select(c("token").alias("keyword"))
    exact = each.join(words, c("token") == c("keyword")).select("id", "keyword")
    rest = each.join(words, c("token") == c("keyword"), "left_anti")
    parts = F.expr("flatten(transform(sequence(2, 7), n -> transform(sequence(1, greatest(length(token) - n + 1, 1)), i -> if(length(token) > n, substring(token, i, n), null))))")
    inside = rest.select("id", F.explode(F.array_compact(parts)).alias("part")).join(words, c("part") == c("keyword")).select("id", "keyword")
    return exact.union(inside).distinct()


def duration_bucket(days: Column) -> Column:
    return F.when(days.between(1, 2), "1-2").when(days.between(3, 4), "3-4").when(days.between(5, 7), "5-7").when(days.between(8, 14), "8-14").when(days >= 15, "15+")


def whitespace(values: DataFrame, region: str, least: int = 3) -> DataFrame:
    """axis, value, national, regional, score, first_seen of (id, region, axis, value) rows of one type's records.

    score = min(1, national / 12) * (1 - min(1, regional / the region's records)), four digits.
    """
    rows = values.groupBy().agg(F.countDistinct(F.when(c("region") == region, c("id"))).alias("rows"))
    per = values.where("value is not null").groupBy("axis", "value").agg(F.countDistinct("id").alias("national"), F.countDistinct(F.when(c("region") == region, c("id"))).alias("regional"), F.min("id").alias("first_seen"))
    score = F.least(F.lit(1.0), c("national") / 12) * (1 - F.least(F.lit(1.0), c("regional") / F.greatest(F.lit(1), c("rows"))))
    return per.where(c("national") >= least).crossJoin(F.broadcast(rows)).select("axis", "value", "national", "regional", F.round(score, 4).alias("score"), "first_seen")


def axis_values(records: DataFrame, words: DataFrame) -> DataFrame:
    """id, region, axis, value for the four axes; undecided venues don't count. Every record has a row, with or without a value."""
    axes = F.array(
        F.struct(F.lit("venue").alias("axis"), F.when(c("venue_type") != UNDECIDED, c("venue_type")).alias("value")),
        F.struct(F.lit("month").alias("axis"), c("start_month").cast("string").alias("value")),
        F.struct(F.lit("duration").alias("axis"), duration_bucket(c("duration_days")).alias("value")),
    )
    flat = records.select("id", "region", F.explode(axes).alias("a")).select("id", "region", "a.axis", "a.value")
    return flat.union(records.select("id", "region").join(words, "id").select("id", "region", F.lit("keyword"), "keyword"))


def months(spark: SparkSession, records: DataFrame, region: str, kind: str) -> DataFrame:
    """All 12 months with the counts of all records, of the region, and of its type; level by the last."""
    counts = records.groupBy(c("start_month").alias("month")).agg(F.count("*").alias("national"), F.count_if(c("region") == region).alias("regional"), F.count_if((c("region") == region) & (c("festival_type") == kind)).alias("same_type"))
    every = spark.range(1, 13).select(c("id").cast("int").alias("month")).join(counts, "month", "left").na.fill(0)
    return every.withColumn("level", F.when(c("same_type") >= 6, "HIGH").when(c("same_type") >= 3, "MEDIUM").otherwise("LOW"))


def quiet_months(distribution: DataFrame, n: int = 3) -> DataFrame:
    return distribution.where("national > 0").orderBy("same_type", c("national").desc(), "month").limit(n)


def cost_rows(cohort: DataFrame) -> DataFrame:
    """Records with at least 1,000 visitors and a budget, with cpv, the budget per visitor."""
    return cohort.where("visitors >= 1000 and budget_krw > 0").withColumn("cpv", c("budget_krw") / c("visitors"))


def cost_summary(cohort: DataFrame) -> DataFrame:
    """n, median, p25, p75 of cpv, from 20 records on without the lowest and highest twentieth.

    Which slices of the value range hold the ranks that are left is known from counts; only their values are sorted. A slice is
    a hundredth wide whatever the extremes, so an outlier moves nothing, and equal values are one row with their number.
    """
    trimmed = lambda n: F.when(n < 20, 0).otherwise(F.floor(n * 0.05))
    ps = {"median": 0.5, "p25": 0.25, "p75": 0.75}
    found = exact_quantiles(cost_rows(cohort).withColumn("all", F.lit(0)), ["all"], "cpv", ps, trimmed)
    return found.groupBy().agg(F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("n"), *(half_up(F.max(n)).alias(n) for n in ps))


def top_efficient(cohort: DataFrame, n: int = 5) -> DataFrame:
    rows = cost_rows(cohort)
    middle = exact_quantiles(rows.withColumn("all", F.lit(0)), ["all"], "visitors", {"middle": 0.5}).select("middle")
    return rows.crossJoin(F.broadcast(middle)).where(c("visitors") >= c("middle")).orderBy("cpv", "id").limit(n)


def references(rows: DataFrame, by: list[str], n: int = 4) -> DataFrame:
    """Of each value of ``by`` the ``n`` records with most visitors, with labels and the cost per visitor; rn is their order, ties by id."""
    order = Window.partitionBy(*by).orderBy(F.coalesce("visitors", F.lit(0)).desc(), "id")
    top = rows.withColumn("rn", F.row_number().over(order)).where(c("rn") <= n)
    cost = F.when((c("visitors") > 0) & c("budget_krw").isNotNull(), half_up(c("budget_krw") / c("visitors"))).alias("cost_per_visitor")
    return top.select(*by, "rn", "id", "festival_name", label(c("region"), REGIONS).alias("region_label"), "district", label(c("festival_type"), TYPES).alias("type_label"), label(c("venue_type"), VENUES).alias("venue_label"), "start_month", "duration_days", "budget_krw", "visitors", cost)


def cohort_summary(records: DataFrame, region: str, kind: str, venue: str) -> DataFrame:
    same, here = c("festival_type") == kind, c("region") == region
    return records.agg(F.count_if(same).alias("national_same_type"), F.count_if(here).alias("region"), F.count_if(same & here).alias("region_same_type"), F.count_if(same & here & (c("venue_type") == venue)).alias("region_same_type_venue"))


def cohort(records: DataFrame, region: str, kind: str) -> DataFrame:
    """The region's records of the type if there are at least 8, else all of the type."""
    same = records.where(c("festival_type") == kind)
    n = same.agg(F.count_if(c("region") == region).alias("here"))
    return same.crossJoin(F.broadcast(n)).where((c("here") < 8) | (c("region") == region)).drop("here")


def cards(spark: SparkSession, records: DataFrame, words: DataFrame, region: str, kind: str, venue: str, month: int | None, days: int) -> DataFrame:
    """kind, value, partner, score, emitted: the recommendation cards, best first, ties in the order they are emitted."""
    same = records.where(c("festival_type") == kind)
    bucket = spark.range(1).select(duration_bucket(F.lit(days)).alias("b")).first()["b"]
    other = lambda axis, own: (c("axis") == axis) & (c("value") != own if own else F.lit(True))
    wanted = other("venue", venue) | other("duration", bucket) | (c("axis") == "keyword") & (c("regional") == 0)
    order = Window.partitionBy("axis").orderBy(c("score").desc(), c("national").desc(), "first_seen", "value")
    best = whitespace(axis_values(same, words), region).where(wanted).withColumn("rn", F.row_number().over(order)).where("rn = 1")
    pct = lambda x: F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) * 100 + 0.5).cast("int")
    none = F.lit(None).cast("string")
    # the partner of an imported keyword is the region's most frequent one that is another word, so one of the first two
    local = records.where(c("region") == region).select("id").join(words, "id").groupBy("keyword").agg(F.count("*").alias("k"), F.min("id").alias("f")).orderBy(c("k").desc(), "f", "keyword").limit(2)
    local = local.agg(F.transform(F.array_sort(F.collect_list(F.struct(-c("k"), "f", "keyword"))), lambda x: x["keyword"]).alias("local"))
    partner = F.when(c("axis") == "keyword", F.get(F.filter("local", lambda x: x != c("value")), F.lit(0)))
    turn = F.when(c("axis") == "venue", F.struct(F.lit("VENUE_SHIFT").alias("kind"), F.lit(1).alias("emitted"))).when(c("axis") == "keyword", F.struct(F.lit("KEYWORD_MASHUP").alias("kind"), F.lit(3).alias("emitted"))).otherwise(F.struct(F.lit("DURATION_TUNE").alias("kind"), F.lit(4).alias("emitted")))
    found = best.crossJoin(F.broadcast(local)).withColumn("turn", turn).select("turn.kind", "value", partner.alias("partner"), pct(c("score")).alias("score"), "turn.emitted")

    quiet = quiet_months(months(spark, records, region, kind))
    quiet = quiet.orderBy((c("month") == month) if month else F.lit(False), "same_type", c("national").desc(), "month").limit(1)
    total = same.agg(F.count_if(c("region") == region).alias("total"))
    timing = quiet.crossJoin(F.broadcast(total)).select(F.lit("TIMING_SHIFT"), c("month").cast("string"), none, pct(1 - c("same_type") / F.greatest(F.lit(1), c("total"))), F.lit(2))
    cost = cost_summary(cohort(records, region, kind)).where("n > 0").select(F.lit("BUDGET_EFFICIENCY"), c("median").cast("string"), none, F.lit(0), F.lit(5))
    return found.union(timing).union(cost).orderBy(c("score").desc(), "emitted")
