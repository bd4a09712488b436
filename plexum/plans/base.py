"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(*tables: str, sql: str | None = None):
    """Register a function of DataFrames, one for each table, under its own name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
