"""Every query with SQL against DuckDB on the smallest tables; every other one runs."""

import glob
import os
from collections import Counter

import duckdb
import pytest
from lodeline.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name in catalogue.SQL:
        told = duck.execute(catalogue.SQL[name])
        have = [c[0] for c in told.description]
        assert sorted(have) == columns
        assert Counter(repr(tuple(plain(r[have.index(c)]) for c in columns)) for r in told.fetchall()) == rows
