"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Stated cases of operators: results written by hand, for the tests alone.
CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) under its name, with the SQL that gives the same rows where there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def case(sql: str) -> Callable:
    """Keep a function on stated rows for the tests, with the SQL of its stated result; it reads no table, so it is not registered."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        CASES[f.__name__] = (f, sql)
        return f

    return add
