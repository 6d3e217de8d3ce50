"""Queries over the test tables that exercise each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import steps

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    """Register a query under its function's name; sql is its DuckDB twin, if SQL can express it."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    steps.arrow(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


from . import addresses, archive, crawl, pieces, texts  # noqa: E402,F401  each registers its queries
