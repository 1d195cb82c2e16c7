"""Queries of this subpackage and, where SQL can say it, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``builder(spark, folder) -> DataFrame`` under ``name``."""

    def wrap(builder):
        QUERIES[name] = builder
        if sql is not None:
            ORACLES[name] = sql
        return builder

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
