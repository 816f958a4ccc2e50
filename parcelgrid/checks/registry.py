"""Registry of runnable queries and the SQL that states their expected rows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcelgrid import testbed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2026-06-01 00:00:00"


class Tables:
    """Lazy access to given and derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in testbed.STATEMENTS:
            return testbed.derived(self.spark, self.sf_dir, name)
        return testbed.base(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ("listings",)):
    """Registers `fn(tables) -> DataFrame` under an operator's name."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            prefix = testbed.with_clause(*uses) if uses else ""
            ORACLES[name] = prefix + sql
        return fn
    return register
