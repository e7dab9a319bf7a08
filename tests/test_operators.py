"""Small cases of the rules, and the closed form of the selection against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from planlens.functions import scoring as S
from planlens.operators import estimate, parity, planner, policy, selection
from planlens.sources import ingest


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_scoring(spark):
    assert one(spark, S.half_up(F.lit(2.5)), S.half_up(F.lit(-2.5)), S.clip(F.lit(5.0), 0, 2)) == (3, -2, 2.0)


def test_ingest_functions(spark):
    got = one(spark, ingest.trim_to_null(F.lit("　a ")), ingest.trim_to_null(F.lit("  ")), ingest.strip_prefix(F.lit("3. x")), ingest.to_int(F.lit("2.5")), ingest.to_int(F.lit("x")), ingest.million_to_krw(F.lit("1.234")), ingest.dash_to_null(F.lit("-")))
    assert got == ("a", None, "x", 3, None, 1234000, None)
    assert str(one(spark, ingest.rolled_date(F.lit(2024), F.lit(2), F.lit(30)))[0]) == "2024-03-01"
    assert one(spark, *ingest.parse_types(F.lit("A| B |A||Z"), ["A", "B"])) == (["A", "B"], ["Z"])
    assert one(spark, *ingest.duration(F.lit(None).cast("int"), F.to_date(F.lit("2024-01-05")), F.to_date(F.lit("2024-01-01")))) == (None, "UNKNOWN")


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("﻿a,b\n1,\n")
    assert [tuple(r) for r in ingest.read_csv(spark, str(p), ["a", "b"]).collect()] == [("1", None)]
    with pytest.raises(ValueError, match="lacks"):
        ingest.read_csv(spark, str(p), ["c"])
    p.write_text("")
    with pytest.raises(ValueError, match="empty"):
        ingest.read_csv(spark, str(p), ["a"])


def test_accept_stops_a_load(spark):
    a = spark.createDataFrame([("n", 1.0)], "metric string, value double")
    ingest.accept(ingest.acceptance(a, a))
    with pytest.raises(ValueError, match="not accepted"):
        ingest.accept(ingest.acceptance(a, a.union(spark.createDataFrame([("m", 2.0)], a.schema))))


def test_write_records_replaces_a_year(spark, tmp_path):
    df = spark.createDataFrame([(1, 2000), (2, 2001)], "id int, dataset_year int")
    for _ in range(2):
        ingest.write_records(df, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2


def test_policy_upsert(spark):
    got = {r.dataset_year: r for r in policy.upsert(policy.status_table(spark), spark.createDataFrame([(1999, policy.PARTIAL)], "dataset_year int, status string"), "2001-01-01 00:00:00").collect()}
    assert got[1999].status == policy.PARTIAL and got[1999].published_at is None and len(got) == 2


def test_tokens_are_replaced_one_after_the_other(spark):
    names = ["제12회 서울 불빛축제(2024)", "포항국제불빛축제", "2024년 고성군 공룡엑스포", "함께하는 철쭉제"]
    terms = planner.removal_terms(["서울"], ["포항시", "고성군"])
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(planner.tokens(F.col("n"), terms)).collect()]
    assert got == [["불빛"], ["국제불빛"], ["공룡"], ["철쭉"]]
    abcd = spark.createDataFrame([("xabcdx",)], "n string").select(planner.tokens(F.col("n"), ["bcd", "ab"])).first()[0]
    assert abcd == ["xa"]


def test_parity(spark):
    a = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "k int, x int, y double")
    b = spark.createDataFrame([(1, 2, 1.05), (3, 3, 1.0)], "k int, x int, y double")
    got = {r.field: (r.passed, r.failed) for r in parity.summary(parity.differences(a, b, ["k"], ["x"], {"y": 0.1})).collect()}
    assert got == {"x": (1, 2), "y": (1, 2)}


def loop(rows, applicable, v1):
    """The selection as a loop: rows are (id, tier, year, sim)."""
    taken, reached, floor, gate = [], 1, None, False
    for level in range(1, 7):
        if level not in applicable:
            continue
        taken += [r for r in rows if r[1] == level and (floor is None or r[3] >= floor)]
        reached = level
        years = {}
        for r in taken:
            years[r[2]] = years.get(r[2], 0) + r[3] ** 2
        share = round(max(years.values()) / sum(years.values()), 12) if years else 0
        if len(taken) >= S.ENOUGH:
            if not v1 or share <= 0.5:
                break
            if not gate:
                gate, floor = True, round(max(r[3] for r in taken) - 0.05, 12)
    return {r[0] for r in taken}, reached, gate


def test_closed_form_equals_the_loop(spark):
    rng, rows, want = random.Random(5), [], {}
    for q in range(40):
        n, own = rng.randint(0, 70), []
        for i in range(n):
            own.append((i, rng.choice([1, 2, 3, 4, 5, 6, 6]), rng.choice([2001, 2001, 2001, 2002, 2003]), round(rng.choice([0.5, 0.9, 0.94, 0.95, 1.0]) - rng.random() * 0.02, 12)))
        rows += [(q, *r) for r in own]
        if own:
            want[q] = (loop(own, range(1, 7), False), loop(own, range(1, 7), True))
    df = spark.createDataFrame(rows, "query_id int, id int, tier int, dataset_year int, sim double").withColumn("w", F.col("sim") * F.col("sim"))
    for i, select in enumerate((selection.select_v0, selection.select_v1)):
        got = {}
        for r in select(df).collect():
            got.setdefault(r.query_id, (set(), r.reached_tier, r.gate))[0].add(r.id)
        assert {q: got[q] for q in want} == {q: w[i] for q, w in want.items()}


def test_weighted_quantiles(spark):
    rows = [(1, 10.0, 1.0, 1), (1, 20.0, 1.0, 2), (1, 40.0, 2.0, 3), (2, 7.0, 1.0, 1)]
    got = {r.query_id: r for r in estimate.weighted_quantiles(spark.createDataFrame(rows, "query_id int, value double, w double, rn int"), (0.25, 0.5)).collect()}
    assert (got[1].p25, got[2].p50) == (15.0, 7.0)
    assert abs(got[1].p50 - (20 + 20 * (0.5 - 0.375) / 0.375)) < 1e-9
