"""Every query that has SQL gives DuckDB's rows; every query runs."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    cur = duck.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr(tuple(norm(r[i]) for i in at)) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(SQL) <= set(entry.queries())
