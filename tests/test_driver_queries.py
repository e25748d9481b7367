"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

from wayloom.plans import driver

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(found, names, cols):
    at = [names.index(c) for c in cols]
    clean = lambda x: round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(clean(r[i]) for i in at) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(driver.QUERIES))
def test_query(spark, sql, name):
    df = driver.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = rows(df.collect(), df.columns, cols)
    if name in driver.SQL:
        rel = sql.sql(driver.SQL[name])
        assert got == rows(rel.fetchall(), list(rel.columns), cols)
    else:
        assert got
