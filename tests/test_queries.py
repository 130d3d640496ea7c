"""Every query of the analytics side against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from parley.plans import catalogue, service  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "customer orders events documents pages benchmark labels conversations supplier".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    if name not in catalogue.ORACLE:
        assert rows
        return
    cur = duck.execute(catalogue.ORACLE[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(tuple(str(r[i]) for i in at) for r in cur.fetchall())
