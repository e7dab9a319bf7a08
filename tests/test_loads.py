"""CSV files of many headers, loads that are whole or not there, stages, reports and request bodies."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from planlens.operators import policy
from planlens.plans import validation
from planlens.sources import csvfiles, ingest, staging, store


def test_columns_in_another_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("﻿y,x\r\n20,10\r\n")
    (tmp_path / "c.csv").write_text('"y", "more, or less",x\n200,"a ""b""\nc",100\n')
    (tmp_path / "_d.csv").write_text("no data\n")
    got = ingest.read_csv(spark, str(tmp_path), ["x", "y"])
    assert got.columns == ["x", "y", "more, or less"]
    assert sorted(map(tuple, got.collect()), key=str) == [("1", "2", None), ("10", "20", None), ("100", "200", 'a "b"\nc')]
    (tmp_path / "e.csv").write_text("x\n1\n")
    with pytest.raises(ValueError, match="e.csv lacks the headers y"):
        ingest.read_csv(spark, str(tmp_path), ["x", "y"])
    (tmp_path / "e.csv").write_text("x,y,x\n1,2,3\n")
    with pytest.raises(ValueError, match="twice"):
        ingest.read_csv(spark, str(tmp_path), ["x", "y"])
    with pytest.raises(ValueError, match="no file"):
        ingest.read_csv(spark, str(tmp_path / "nothing*"), ["x"])


def test_faulty_lines_are_listed(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3\n4,5,6\n")
    (tmp_path / "b.csv").write_text("y,x\n7,8\n9\n")
    rows = ingest.read_csv(spark, str(tmp_path), ["x", "y"], corrupt="_line").cache()
    assert sorted(r.line for r in csvfiles.faulty(rows, "_line").collect()) == ["3", "4,5,6", "9"]
    assert sorted((r.x, r.y) for r in rows.where("_line is null").collect()) == [("1", "2"), ("8", "7")]


def canonical(spark, rows):
    names = ["dataset_year", "source_sheet", "source_row", "source_sha256", "festival_name", "festival_type", "budget_quality_flag", "budget_total_million", "region", "venue_type"]
    raw = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    return ingest.canonical(raw, {"서울": "SEOUL"}, ["A", "B"], {"v": "V"})


def row(year, n, kind="A", flag="VALID", million="1.5", region="서울", venue="v", name="n"):
    return (str(year), "s", str(n), f"h{year}", name, kind, flag, million, region, venue)


def read(spark, root):
    years = lambda df: sorted((r.dataset_year, r["count"]) for r in df.groupBy("dataset_year").count().collect())
    return years(store.records(spark, root)), years(store.types(spark, root)), sorted((r.dataset_year, r.total_rows) for r in store.batches(spark, root).collect())


def test_a_load_is_whole_or_not_there(spark, tmp_path):
    root = str(tmp_path / "store")
    first = canonical(spark, [row(2001, 1), row(2001, 2, "A|B"), row(2002, 1, ""), row(2003, 1, flag="ODD")])
    assert store.load(first, root, "f", "c", "1") == {2001: "IMPORTED", 2002: "IMPORTED"}
    there = ([(2001, 2), (2002, 1)], [(2001, 3)], [(2001, 2), (2002, 1)])
    assert read(spark, root) == there
    # killed in a task after other tasks have written, and stopped by the gate
    more = canonical(spark, [row(2004, n) for n in range(50)])
    killed = more.withColumn("event_mode", F.when(F.col("source_row") == 49, F.raise_error(F.lit("killed"))).otherwise("x"))
    with pytest.raises(Exception, match="killed"):
        store.load(killed, root, "f", "c", "1")
    seen = {}

    def gate(written, metrics):
        seen.update(metrics)
        ingest.accept(ingest.accepted_report(ingest.import_report(written), ingest.expectations(spark)))

    with pytest.raises(ValueError, match="not accepted"):
        store.load(canonical(spark, [row(2005, 1), row(2005, 2, flag="ODD", region="?")]), root, "f", "c", "1", gate)
    assert seen == {"rows": 2, "fatal_rows": 1, "issues": 2}
    # types can't be written: parents are there already, and still nothing is seen
    folder = os.path.join(root, "types")
    os.rename(folder, folder + "-away")
    open(folder, "w").close()
    with pytest.raises(Exception):  # noqa: B017  whatever Hadoop says of a file in the way
        store.load(more, root, "f", "c", "1")
    os.remove(folder)
    os.rename(folder + "-away", folder)
    assert read(spark, root) == there
    assert len(store.sweep(spark, root)) >= 2 and store.sweep(spark, root) == []
    assert read(spark, root) == there
    # the same content again is skipped; another version of the importer is a batch of its own
    assert store.load(first, root, "f", "c", "1") == {2001: "ALREADY_IMPORTED", 2002: "ALREADY_IMPORTED"}
    assert set(store.load(first, root, "f", "c", "2").values()) == {"IMPORTED"}
    assert read(spark, root)[2] == [(2001, 2), (2001, 2), (2002, 1), (2002, 1)]
    assert store.load(first.where("false"), root, "f", "c", "3") == {}


def test_report_in_one_pass(spark):
    rows = [row(2001, 1, million="1"), row(2001, 2, "A|B", million="2"), row(2001, 3, "B|A|X", million="5"), row(2002, 4, flag="MISSING_OR_NONPOSITIVE", million="7"), row(2002, 5, million=None, region="??", venue="w"), row("x", 6, region="!", venue="z"), row(2002, 7, flag=None, region="??")]
    df = canonical(spark, rows)
    got = {(r.metric, r.key): r.value for r in ingest.import_report(df).collect()}
    want = {("total_rows", ""): 5, ("fatal_rows", ""): 2, ("multi_type_rows", ""): 2, ("type_combinations", ""): 1, ("source_hashes", ""): 2, ("year_first", ""): 2001, ("year_last", ""): 2002, ("unmapped_regions", ""): 2, ("unmapped_venues", ""): 2}
    want |= {("region_value", "서울"): 4, ("region_value", "??"): 2, ("region_value", "!"): 1, ("unmapped_region", "??"): 2, ("unmapped_venue", "w"): 1, ("unmapped_venue", "z"): 1, ("venue_value", "v"): 5, ("median", "2001"): 2.0, ("p75", "2001"): 3.5, ("n_budgets", "2001"): 3, ("most", "2001"): 5}
    want |= {("rows", "2001"): 3, ("rows", "2002"): 2, ("flag", "VALID"): 4, ("year_flag", "2002:VALID"): 1, ("issues", ""): 8}
    assert {k: got.get(k) for k in want} == want
    assert ("median", "2002") not in got
    expected = spark.createDataFrame([("total_rows", "", 5.0), ("rows", "1999", 0.0), ("median", "2001", 2.009), ("median", "2002", 0.0), ("median", "2001", 2.02)], "metric string, key string, value double")
    assert sorted((r.metric, r.key, r.expected, r.ok) for r in ingest.accepted_report(ingest.import_report(df), expected).collect()) == [("median", "2001", 2.009, True), ("median", "2001", 2.02, False), ("median", "2002", 0.0, False), ("rows", "1999", 0.0, True), ("total_rows", "", 5.0, True)]
    assert ingest.import_report(df.where("false")).where("metric = 'total_rows'").first().value == 0
    plan = ingest.counted(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1


def test_names_are_composed_at_ingest(spark):
    got = canonical(spark, [row(2001, 1, name="한é")]).first()
    assert got.festival_name == "한é"


def test_stages_are_written_once_and_go_with_the_session(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(5).write.parquet(path)
    built = []

    def stage(extra=""):
        return staging.staged(spark, "t", [path], "v" + extra, lambda: built.append(1) or spark.read.parquet(path))

    a, b = stage(), stage()
    assert a is b and len(built) == 1 and a.count() == 5
    stage("2")
    assert len(built) == 2
    spark.range(3).write.mode("append").parquet(path)  # the input changes
    assert stage().count() == 8 and len(built) == 3
    shutil.rmtree(stage().stored)
    assert stage().count() == 8 and len(built) == 4
    staging.close(spark)
    assert not os.path.exists(a.stored)
    assert stage().count() == 8 and len(built) == 5


def test_two_request_bodies(spark):
    base = {"regionCode": "R", "festivalType": "T", "festivalTypes": ["T"], "venueType": "V", "durationDays": 3}
    bodies = [base | {"planningYear": 1995, "referenceDataPolicy": "INCLUDE_PUBLISHED_SAME_YEAR"}, base | {"planningYear": 1999, "referenceDataPolicy": "INCLUDE_PUBLISHED_SAME_YEAR"}, base | {"planningYear": 1996}]
    frame = lambda b: spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(b)], "request_id int, body string")
    found = validation.multi_year(frame(bodies), ["R"], ["T"], ["V"])
    usable = spark.createDataFrame([(1995,), (1999,)], "dataset_year int")
    status = lambda rows: {r.request_id: r.status for r in validation.with_window(found, rows, policy.status_table(spark)).collect()}
    # 1995 is not complete, so only earlier years count, and there are none
    assert status(usable) == {0: 422, 1: 200, 2: 200}
    assert status(usable.where("dataset_year = 1999")) == {0: 422, 1: 200, 2: 422}
    assert status(usable.where("false")) == {0: 422, 1: 422, 2: 422}
    months = [base | {"planningYear": 2001} | m for m in ({}, {"startMonth": None}, {"startMonth": 12}, {"startMonth": 0}, {"startMonth": "5"})]
    got = {r.request_id: (r.status, r.problem) for r in validation.planner(frame(months), ["R"], ["T"], ["V"]).collect()}
    assert got == {0: (200, None), 1: (400, "startMonth"), 2: (200, None), 3: (400, "startMonth"), 4: (400, "startMonth")}
