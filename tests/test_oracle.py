"""Every registered query against its SQL in DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import operations, parts, quality, replication, writing  # noqa: F401
from tidemark.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def text(x) -> str:
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_sql(spark):
    for name in set(QUERIES) - set(ORACLE_SQL):
        assert QUERIES[name](spark, SF).count() > 0
