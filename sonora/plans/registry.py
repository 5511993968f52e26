"""Collects the registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """All double columns rounded, with one zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def plan(sql: str | None = None, doubles: str = "", digits: int = 6, name: str | None = None):
    """Registers a query; `sql` gives the same rows in DuckDB, with the same rounding of `doubles`."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql is not None:
            replace = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + 0.0e0 AS {c}" for c in doubles.split())
            ORACLES[key] = f"WITH {VIEWS.strip()}, result AS ({sql.strip()}) SELECT *{f' REPLACE ({replace})' if replace else ''} FROM result"
        return f

    return register
