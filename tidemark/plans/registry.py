"""Queries by name with their SQL: each module of this folder adds its own with @query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def as_of():
    return F.lit(fixtures.AS_OF).cast("timestamp_ntz")



class Tables:
    """Tables of a folder by name: t.orders, or a fixture such as t.change_log."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    """Register a function of Tables; sql is what DuckDB runs, {name} standing for tables and fixtures."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = fixtures.oracle(sql)
        return f

    return register
