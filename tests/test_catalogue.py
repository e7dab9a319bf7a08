"""Every query against its DuckDB oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from planlens import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
    return str([shown(y) for y in x]) if isinstance(x, (list, tuple)) else str(x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, SF)
    want = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    a = sorted(tuple(shown(r[c]) for c in order) for r in got.collect())
    b = sorted(tuple(shown(r[names.index(c)]) for c in order) for r in want.fetchall())
    assert a == b


def test_entry_registers_the_catalogue():
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(catalogue.ORACLES) <= set(__spark_entry__.oracle_sql())
