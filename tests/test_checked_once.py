"""Equal bodies are checked once, and what records say reaches a request without a join of requests with themselves."""

import re

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from planlens.operators import policy
from planlens.plans import validation

BODIES = ['{"regionCode": "R", "festivalType": "T", "festivalTypes": ["T"], "venueType": "V", "durationDays": 3, "planningYear": %d}' % y for y in (1990, 1999)] + ["no json", None]


def bodies(spark, n=400):
    return spark.createDataFrame([(i, BODIES[i % 4]) for i in range(n)], "request_id int, body string").repartition(3)


def self_joins(df):
    return re.findall(r"Join \w+, .*request_id.*", df._jdf.queryExecution().optimizedPlan().toString())


def test_a_body_is_judged_once_however_many_ask(spark):
    seen = spark.sparkContext.accumulator(0)

    def judge(body):
        seen.add(1)
        return len(body or "")

    one = F.udf(judge, IntegerType()).asNondeterministic()
    got = validation.judged(bodies(spark), lambda once: once.withColumn("status", one("body"))).collect()
    assert len(got) == 400 and all(r.status == len(r.body or "") for r in got)
    assert seen.value == 4


def test_windows_come_without_a_join_of_requests(spark):
    usable = spark.createDataFrame([(1995,), (1998,)], "dataset_year int")
    found = validation.with_window(validation.multi_year(bodies(spark), ["R"], ["T"], ["V"]), usable, policy.status_table(spark))
    assert not self_joins(found)
    want = [(422, "no data"), (200, None), (400, "json"), (400, "json")]
    assert sorted((r.request_id, r.status, r.problem) for r in found.collect()) == [(i, *want[i % 4]) for i in range(400)]


def test_no_record_at_all_comes_without_a_join_of_requests(spark):
    usable = spark.createDataFrame([(1995,)], "dataset_year int")
    asked = bodies(spark).withColumn("body", F.replace("body", F.lit("1999"), F.lit("2001")))
    for rows, want in ((usable, (200, None)), (usable.limit(0), (503, "no data"))):
        found = validation.without_records(validation.planner(asked, ["R"], ["T"], ["V"]), rows, 503)
        assert not self_joins(found)
        got = {(r.request_id % 4, r.status, r.problem) for r in found.collect()}
        assert got == {(0, 400, "planningYear"), (1, *want), (2, 400, "json"), (3, 400, "json")}
