"""The whole canonical record: cycle, placeholders of districts, budgets, notes and the source of the duration."""

from decimal import Decimal

import pytest

from planlens.sources import ingest


def canonical(spark, **values):
    row = {h: f" {h} " for h in ingest.HEADERS} | {"budget_total_raw": " 1 "} | values
    raw = spark.createDataFrame([tuple(row.values())], ", ".join(f"{h} string" for h in row))
    return ingest.canonical(raw, {}, [], {}).first()


def test_all_fields(spark):
    got = canonical(spark, cycle=" 격년", first_held_year="1999", visitor_total_persons="1200.5", budget_national_million="1.5", budget_local_million="2", budget_other_million="x", duration_source="UNPARSED", district_raw=" 수원시 ")
    assert (got.cycle_raw, got.cycle_type, got.first_held_year, got.visitor_total_persons) == ("격년", "BIENNIAL", 1999, 1201)
    assert (got.budget_national_million, got.budget_local_million, got.budget_other_million) == (Decimal("1.500"), Decimal("2.000"), None)
    for n in ("festival_type_raw", "venue_raw", "venue_type_raw", "period_raw", "duration_note_raw", "event_mode", "event_status", "budget_quality_note"):
        assert got[n] == n
    assert (got.budget_total_raw, got.duration_source, got.district_raw, got.district) == (" 1 ", "UNPARSED", "수원시", "수원시")
    assert "duration_source" not in [i.field for i in got.issues]


@pytest.mark.parametrize("name", ["-", " 본청 ", "시", "제주도 본청"])
def test_placeholders_are_no_districts(spark, name):
    got = canonical(spark, district_raw=name, cycle="가끔", duration_source="ODD")
    assert (got.district, got.district_raw, got.cycle_type) == (None, name.strip(), None)
    assert [i.fatal for i in got.issues if i.field == "duration_source"] == [False]
