"""Every registered factor query runs, and agrees with its SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quantloom import queries as factor

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        out.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return out


def plain(v):
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return round(v, 7) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(factor.oracle_sql()))
def test_query_agrees_with_sql(spark, con, name):
    df = factor.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(factor.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    key = lambda r: [(x is None, str(x)) for x in r if not isinstance(x, float)] + [(x is None, x or 0) for x in r if isinstance(x, float)]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    want = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, rel=1e-6, abs=1e-7) if all(isinstance(x, float) for x in a) else all(x == y or (isinstance(x, float) and abs(x - y) < 1e-6 * max(1, abs(x))) for x, y in zip(a, b, strict=True))


def test_entry(spark):
    assert entry.entry(spark).columns == ["factor_quantile", "period", "mean_return", "std_error", "count"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
