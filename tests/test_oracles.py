"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
LLM = {k for k in entry.queries() if k == "pipeline" or k.startswith("op") and k[2].isdigit()}
SHARED = sorted(k for k in entry.oracle_sql() if k not in LLM)


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.6g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.6g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", SHARED)
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = sorted(str(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = sorted(str(tuple(plain(r[cols.index(c)]) for c in sorted(cols))) for r in cur.fetchall())
    assert sorted(cols) == sorted(df.columns)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
