"""A table of request bodies answered end to end: refusals and estimates, one JSON answer for each body."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens.operators import estimate, policy, selection
from planlens.operators.tierindex import TierIndex
from planlens.plans import requests, validation
from planlens.sources.staging import materialise

c = F.col


def windows(index: TierIndex, queries: DataFrame) -> DataFrame:
    """query_id, pool_earliest, pool_latest: the years of the window that have records."""
    years = selection.by_year(queries, *index.years).join(index.levels.where("kind = 'a'").select("dataset_year").distinct(), "dataset_year")
    return years.groupBy("query_id").agg(F.min("dataset_year").alias("pool_earliest"), F.max("dataset_year").alias("pool_latest"))


def planned(index: TierIndex, queries: DataFrame) -> DataFrame:
    """``estimate.planning_result`` of the queries, which have their policies resolved."""
    return estimate.planning_result(estimate.final_sample(index, queries), queries, windows(index, queries))


def multi_year(bodies: DataFrame, index: TierIndex, status: DataFrame, regions: list[str], types: list[str], venues: list[str]) -> DataFrame:
    """request_id, status, problem, answer: for each body (request_id, body) the answer in JSON, a message or the planning result.

    Equal bodies are one row, written out, until the end. The right ones are reduced to the distinct requests, which are estimated
    together through the index; each body is joined with its answer again.
    """
    once = bodies.select(c("body").alias("request_id"), "body").distinct()
    checked = validation.multi_year(once, regions, types, venues)
    found = materialise(validation.with_window(checked, index.rows, status), "checked")
    asked = requests.of_bodies(found)
    distinct = policy.resolve(asked.drop("request_id").dropDuplicates(["query_id"]), status).withColumn("first_year", F.lit(0))
    results = planned(index, selection.local(distinct))
    answers = results.select("query_id", F.to_json(F.struct(*(x for x in results.columns if x != "query_id"))).alias("result"))
    answered = asked.select("request_id", "query_id").join(answers, "query_id").select("request_id", "result")
    message = F.to_json(F.struct(F.concat(F.lit("refused: "), "problem").alias("message")))
    said = found.join(answered, "request_id", "left").select(c("body").alias("__body"), "status", "problem", F.coalesce("result", message).alias("answer"))
    return bodies.join(said, c("body").eqNullSafe(c("__body"))).select("request_id", "status", "problem", "answer")
