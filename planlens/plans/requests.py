"""The requests of the sample queries, as a DataFrame and as DuckDB rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STRICT, ALLOW = "HISTORICAL_ONLY", "INCLUDE_PUBLISHED_SAME_YEAR"
COLUMNS = "query_id int, q_region string, q_district string, q_types array<string>, q_venue string, q_duration int, q_planning_year int, q_policy string"

MULTI = [
    (1, "ASIA", "NATION_2", ["ECONOMY"], "1-URGENT", 3, 1998, STRICT),
    (2, "EUROPE", None, ["PROMO", "LARGE"], "2-HIGH", 5, 1998, STRICT),
    (3, "AMERICA", None, ["SMALL"], None, 2, 1996, STRICT),
    (4, "AFRICA", "NATION_0", ["MEDIUM"], "4-NOT SPECIFIED", None, 1999, ALLOW),
    (5, "ASIA", None, ["STANDARD"], "5-LOW", 1, 1995, STRICT),
    (6, "MIDDLE EAST", None, ["NONE"], "3-MEDIUM", 4, 2000, ALLOW),
    (7, "EUROPE", "NATION_3", ["ECONOMY"], "1-URGENT", 7, 1997, STRICT),
    (8, "AMERICA", "NATION_1", ["LARGE"], "5-LOW", 2, 1996, ALLOW),
]
SINGLE = [
    (1, "ASIA", "NATION_2", ["BUILDING"], "1-URGENT", 3, 0, STRICT),
    (2, "EUROPE", None, ["MACHINERY"], "4-NOT SPECIFIED", 6, 0, STRICT),
    (3, "AFRICA", None, ["NONE"], "2-HIGH", 2, 0, STRICT),
]


def of_bodies(found: DataFrame) -> DataFrame:
    """The distinct requests of checked bodies (``validation.multi_year``) that are right, in the columns of a query; query_id numbers them by content.

    Requests that differ in nothing are answered once, so their number is that of what can be asked, not of who asks.
    """
    v = F.try_parse_json("body")
    text = lambda n: F.try_variant_get(v, f"$.{n}", "string")
    district = F.nullif(F.trim(text("district")), F.lit(""))
    asked = found.where("status = 200").select(
        text("regionCode").alias("q_region"), district.alias("q_district"), F.array_distinct(F.try_variant_get(v, "$.festivalTypes", "array<string>")).alias("q_types"), text("venueType").alias("q_venue"),
        F.try_variant_get(v, "$.durationDays", "double").alias("q_duration"), F.col("planning_year").alias("q_planning_year"), F.col("policy").alias("q_policy"), "request_id",
    )
    return asked.withColumn("query_id", F.xxhash64("q_region", "q_district", "q_types", "q_venue", "q_duration", "q_planning_year", "q_policy"))


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, COLUMNS)


def sql(rows: list[tuple]) -> str:
    def lit(x: object) -> str:
        if x is None:
            return "null"
        return "[" + ", ".join(map(lit, x)) + "]" if isinstance(x, list) else f"'{x}'" if isinstance(x, str) else str(x)

    body = ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)
    return f"q0(query_id, q_region, q_district, q_types, q_venue, q_duration, q_planning_year, q_policy) as (values {body})"
