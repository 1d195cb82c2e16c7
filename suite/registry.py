"""Registration of queries: a builder over :class:`Views` and, where SQL can say it, DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .views import Views, with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``builder(views) -> DataFrame`` under ``name``."""

    def wrap(builder: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: builder(Views(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return builder

    return wrap


def rnd(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# DuckDB text fragments.
def r(expr: str, digits: int = 4) -> str:
    return f"(round({expr}, {digits}) + 0e0)"


def hav(a: str, b: str, c: str, d: str) -> str:
    """Great-circle km between (a, b) and (c, d), all lng / lat."""
    h = (f"pow(sin(radians(({d})-({b}))/2),2) + cos(radians({b}))*cos(radians({d}))*pow(sin(radians(({c})-({a}))/2),2)")
    return f"(CASE WHEN ({a}) IS NOT NULL AND ({c}) IS NOT NULL THEN 2*6371.0e0*asin(least(1e0, sqrt({h}))) END)"


def half_up(expr: str) -> str:
    return f"CAST(floor({expr} + 0.5e0) AS BIGINT)"
