"""Every query with SQL against that SQL, at the smallest scale."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
Q, O = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def rows(d: pd.DataFrame) -> list[tuple]:
    d = d[sorted(d.columns)]
    return sorted(tuple(round(float(v), 5) + 0.0 if isinstance(v, float) else int(v) if hasattr(v, "dtype") and v.dtype.kind in "iu" else v for v in r) for r in d.itertuples(index=False))


def test_sql_has_queries():
    assert set(O) <= set(Q) and len(Q) > 60


@pytest.mark.parametrize("name", sorted(O))
def test_against_sql(spark, con, name):
    got, want = Q[name](spark, SF).toPandas(), con.execute(O[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, (int, float)) and abs(u - v) <= 1e-4 * (1 + abs(v))) or (u != u and v != v), (x, y)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
