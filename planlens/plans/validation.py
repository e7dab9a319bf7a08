"""Checking requests: JSON bodies in a DataFrame, each with the status and the message that it gets.

A body is parsed with a schema that keeps what kind of value each field had. Rules are tried in order and the first that
fails decides; a body that passes all has status 200 and no message. Equal bodies are checked once: parsing costs far more than
meeting them again. Whether there is data to answer from is known only with the records, so ``without_data``,
``without_records`` and ``with_window`` add that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlens.operators import policy

c = F.col
POLICIES = (policy.STRICT, policy.SAME_YEAR)


def field(name: str) -> Column:
    return F.try_variant_get("v", f"$.{name}", "variant")


def kind(name: str) -> Column:
    """STRING, NUMBER, BOOLEAN, ARRAY, OBJECT, or null where there is none or it is null."""
    found = F.schema_of_variant(field(name))
    simple = F.when(found.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "NUMBER").when(found.startswith("ARRAY"), "ARRAY").when(found.startswith("OBJECT"), "OBJECT").otherwise(found)
    return F.nullif(simple, F.lit("VOID"))


def text(name: str) -> Column:
    return F.when(kind(name) == "STRING", F.try_variant_get("v", f"$.{name}", "string"))


def number(name: str) -> Column:
    return F.when(kind(name) == "NUMBER", F.try_variant_get("v", f"$.{name}", "double"))


def given(name: str) -> Column:
    """Neither missing, null, empty, false nor zero."""
    k = kind(name)
    return F.coalesce(F.when(k == "STRING", text(name) != "").when(k == "NUMBER", number(name) != 0).when(k == "BOOLEAN", F.try_variant_get("v", f"$.{name}", "boolean")).otherwise(k.isNotNull()), F.lit(False))


def one_of(name: str, codes: list[str]) -> Column:
    return F.coalesce(text(name).isin(*codes), F.lit(False))


def at_least(name: str, low: float) -> Column:
    return F.coalesce(number(name) >= low, F.lit(False))


def checked(bodies: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """``bodies`` (request_id, body) with status and problem: the name of the first rule that fails, or null."""
    return judged(bodies, lambda once: ruled(once, rules))


def judged(bodies: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``bodies`` with the columns that ``judge`` adds to their distinct ones."""
    once = judge(bodies.select("body").distinct()).withColumnRenamed("body", "__body")
    return bodies.join(once, c("body").eqNullSafe(c("__body"))).drop("__body")


def ruled(bodies: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    parsed = bodies.withColumn("v", F.try_parse_json("body"))
    chain = F.when(c("v").isNull() | ~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)), "json")
    for name, holds in rules:
        chain = chain.when(~holds, name)
    return parsed.withColumn("problem", chain).withColumn("status", F.when(c("problem").isNull(), 200).otherwise(400)).drop("v")


def _common(regions: list[str], types: list[str], venues: list[str]) -> list[tuple[str, Column]]:
    required = given("regionCode") & given("festivalType") & given("venueType") & given("durationDays")
    return [("required", required), ("regionCode", one_of("regionCode", regions)), ("festivalType", one_of("festivalType", types)), ("venueType", one_of("venueType", venues))]


def single_year(bodies: DataFrame, regions: list[str], types: list[str], venues: list[str]) -> DataFrame:
    return checked(bodies, [*_common(regions, types, venues), ("durationDays", at_least("durationDays", 2))])


def planner(bodies: DataFrame, regions: list[str], types: list[str], venues: list[str]) -> DataFrame:
    # only a missing field passes: a null is given, and no number
    month = field("startMonth").isNull() | F.coalesce(number("startMonth").between(1, 12), F.lit(False))
    return checked(bodies, [*_common(regions, types, venues), ("durationDays", at_least("durationDays", 1)), ("startMonth", month), ("planningYear", at_least("planningYear", 2000))])


def multi_year(bodies: DataFrame, regions: list[str], types: list[str], venues: list[str]) -> DataFrame:
    """Also adds policy, which is HISTORICAL_ONLY where none is asked for."""
    tokens = F.try_variant_get("v", "$.festivalTypes", "array<variant>")
    listed = (kind("festivalTypes") == "ARRAY") & (F.size(tokens) > 0)
    required = given("regionCode") & F.coalesce(listed, F.lit(False)) & given("venueType") & field("durationDays").isNotNull() & field("planningYear").isNotNull()
    known = F.forall(tokens, lambda t: F.coalesce((F.schema_of_variant(t) == "STRING") & F.try_variant_get(t, "$", "string").isin(*types), F.lit(False)))
    year = F.coalesce(number("planningYear") == F.floor(number("planningYear")), F.lit(False))
    asked = kind("referenceDataPolicy").isNotNull() & ~((kind("referenceDataPolicy") == "STRING") & (text("referenceDataPolicy") == ""))
    wanted = F.when(~asked, POLICIES[0]).when(one_of("referenceDataPolicy", list(POLICIES)), text("referenceDataPolicy"))
    rules = [("required", required), ("regionCode", one_of("regionCode", regions)), ("festivalTypes", known), ("venueType", one_of("venueType", venues)), ("durationDays", at_least("durationDays", 2)), ("planningYear", year), ("referenceDataPolicy", wanted.isNotNull())]
    return judged(bodies, lambda once: _with_policy(ruled(once, rules), wanted))


def _with_policy(found: DataFrame, wanted: Column) -> DataFrame:
    return found.withColumn("v", F.try_parse_json("body")).withColumn("policy", F.when(c("status") == 200, wanted)).withColumn("planning_year", F.when(c("status") == 200, number("planningYear").cast("int"))).drop("v")


def _refused(found: DataFrame, empty: Column, status: int) -> DataFrame:
    empty = (c("status") == 200) & empty
    return found.withColumn("problem", F.when(empty, "no data").otherwise(c("problem"))).withColumn("status", F.when(empty, status).otherwise(c("status")))


def without_data(found: DataFrame, pools: DataFrame, status: int) -> DataFrame:
    """Requests that are right but have no record to answer from, by ``pools`` (request_id, n), get ``status``."""
    return _refused(found.join(pools, "request_id", "left"), F.coalesce("n", F.lit(0)) == 0, status).drop("n")


def without_records(found: DataFrame, records: DataFrame, status: int) -> DataFrame:
    """Requests that are right get ``status`` if there is no record at all: one number, whatever the number of requests."""
    return _refused(found.crossJoin(F.broadcast(records.agg(F.count("*").alias("__n")))), c("__n") == 0, status).drop("__n")


def with_window(found: DataFrame, usable: DataFrame, status: DataFrame) -> DataFrame:
    """Multi-year requests that are right but whose window, under the policy that applies, holds no usable record get status 422.

    The policy that applies is not the one asked for, unless the year is complete. Windows have no lower end, so the earliest
    year of all is enough to know: one row, whatever the number of records. It comes to each request where that is.
    """
    asked = found.withColumns({"q_planning_year": c("planning_year"), "q_policy": c("policy")})
    first = usable.agg(F.min("dataset_year").alias("__first"))
    ends = policy.resolve(asked, status).crossJoin(F.broadcast(first))
    return _refused(ends, ~F.coalesce(c("__first") <= c("last_year"), F.lit(False)), 422).select(found.columns)
