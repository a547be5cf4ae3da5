"""One Spark session for all tests, and a DuckDB twin to hold results against."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(df) -> list:
    cols = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df.select(cols).collect()), key=repr)


def duck_rows(sql: str, **tables) -> list:
    """Rows of a query over pandas frames, columns in order of their names."""
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    got = con.sql(sql)
    order = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)
