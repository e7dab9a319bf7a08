"""Publication status by year and the reference-year policy that it decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARTIAL, COMPLETE = "PARTIAL", "PUBLISHED_PLAN_COMPLETE"
STRICT, SAME_YEAR = "HISTORICAL_ONLY", "INCLUDE_PUBLISHED_SAME_YEAR"


def status_table(spark: SparkSession) -> DataFrame:
    """The seed: year, status, published_at (null unless complete)."""
    rows = [(1999, COMPLETE, "2000-01-01 00:00:00"), (2000, PARTIAL, None)]
    return spark.createDataFrame(rows, "dataset_year int, status string, published_at string").withColumn("published_at", F.to_timestamp("published_at"))


def upsert(status: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """``changes`` (dataset_year, status) win over older rows; COMPLETE sets published_at to ``now`` every time, PARTIAL clears it."""
    stamped = changes.select("dataset_year", "status", F.when(F.col("status") == COMPLETE, F.to_timestamp(F.lit(now))).alias("published_at"), F.lit(1).alias("v"))
    both = status.select("dataset_year", "status", "published_at", F.lit(0).alias("v")).union(stamped)
    newest = F.row_number().over(Window.partitionBy("dataset_year").orderBy(F.col("v").desc(), "status"))
    return both.withColumn("rn", newest).where("rn = 1").drop("rn", "v")


def status_by_year(records: DataFrame, status: DataFrame) -> DataFrame:
    """Every year with records, its number of them and its status; a year without one is PARTIAL."""
    counts = records.groupBy("dataset_year").agg(F.count("*").alias("record_count"))
    return counts.join(status, "dataset_year", "left").select("dataset_year", "record_count", F.coalesce("status", F.lit(PARTIAL)).alias("status"), "published_at")


def resolve(queries: DataFrame, status: DataFrame) -> DataFrame:
    """Adds applied_policy and last_year: the planning year itself counts only if asked for and complete."""
    found = queries.join(status.select(F.col("dataset_year").alias("q_planning_year"), F.col("status").alias("__year_status")), "q_planning_year", "left")
    applied = F.when((F.col("q_policy") == SAME_YEAR) & (F.coalesce("__year_status", F.lit(PARTIAL)) == COMPLETE), SAME_YEAR).otherwise(STRICT)
    return found.withColumn("applied_policy", applied).withColumn("last_year", F.col("q_planning_year") - F.when(F.col("applied_policy") == SAME_YEAR, 0).otherwise(1)).drop("__year_status")
