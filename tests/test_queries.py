"""Every query with SQL against DuckDB, compared as rows without order; others must at least run and keep their columns."""

import datetime as dt
import glob
import os

import numpy as np
import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")


def value(v):
    if isinstance(v, (list, np.ndarray)):
        return tuple(value(x) for x in v)
    if isinstance(v, float):
        return None if v != v else float(f"{v:.6g}")
    if isinstance(v, dt.datetime) and v.time() == dt.time(0):
        return v.date()
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


CORE = sorted(n for part in entry.CORE for n in part.SQL)


@pytest.mark.parametrize("name", CORE)
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted({**entry.library.QUERIES, **entry.casework.QUERIES, **entry.training.QUERIES}.keys() - set(CORE)))
def test_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
