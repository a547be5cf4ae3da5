"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import glob
import os

import duckdb
import pytest
from conftest import plain, rows_of

from spanloom.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = rows_of(registry.queries()[name](spark, DIR))
    sql = registry.oracle_sql().get(name)
    if sql:
        want = con.sql(sql)
        order = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
        assert got == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
