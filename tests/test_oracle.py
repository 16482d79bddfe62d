"""Registered queries against their SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from gleaner.plans.oracle import ORACLE
from gleaner.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    cur = c.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(cols)
    key = lambda r: tuple(str(x) for x in r)
    want = sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=key)
    got = sorted((tuple(plain(r[x]) for x in cols) for r in df.collect()), key=key)
    assert got == want


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE)
