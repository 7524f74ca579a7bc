"""Registered queries: one per operator, each with its DuckDB oracle SQL.

A query is ``fn(spark, sf_dir) -> DataFrame`` over the driver's tables.
The oracle is DuckDB SQL over the same tables registered as views; column
names match the Spark result one for one.  Queries that cannot be stated in
SQL register no oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle.strip()
        return fn
    return deco
