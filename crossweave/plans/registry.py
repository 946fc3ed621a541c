"""Registry of queries over the shared tables, each with its check in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """``t.part`` reads ``part.parquet`` of a table folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")

    def texts(self, name: str, *cols: str) -> DataFrame:
        """Columns of a table for costly work per text, over all cores even if the table is one split."""
        return spread(getattr(self, name).select(*cols))


def query(name: str, sql: str | None = None):
    """Registers ``fn(tables)`` as a query, with the SQL that must agree with it."""
    def wrap(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap
