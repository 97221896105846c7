"""Every query with an SQL twin gives the same rows on the smallest tables; the others run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from labelloom.plans import catalogue as core

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(D):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{D}/{f}')")
    return c


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(round(float(v), 6) + 0.0)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, con, name):
    df = core.QUERIES[name](spark, D)
    rows, cols = df.collect(), sorted(df.columns)
    if name not in core.ORACLE:
        return
    cur = con.execute(core.ORACLE[name])
    at = [x[0] for x in cur.description]
    assert sorted(at) == cols
    assert sorted(tuple(norm(r[c]) for c in cols) for r in rows) == sorted(tuple(norm(r[at.index(c)]) for c in cols) for r in cur.fetchall())


def test_entry_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
