"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from mirrortab.llm.scratch import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` gives the same rows on the same tables."""
    def add(f):
        @wraps(f)
        def shipped(spark, folder):
            ship(spark)
            return f(spark, folder)

        QUERIES[name] = shipped
        if sql is not None:
            ORACLES[name] = sql
        return f
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
