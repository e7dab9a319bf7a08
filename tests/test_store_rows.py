"""Loads that look at their rows twice read canonical rows that were written once."""

from planlens import catalogue_import
from planlens.sources import store


def test_loads_read_rows_written_once(spark, monkeypatch):
    given = []
    monkeypatch.setattr(store, "load", lambda rows, *_: given.append(rows.inputFiles()))
    catalogue_import._loads(spark, "/root/testdata/sf0.001")
    assert len(given) == 4
    assert all(files and all("/canonical-" in f for f in files) for files in given)
