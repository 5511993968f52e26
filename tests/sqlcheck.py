"""Holds a query's rows against its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connection(sf_dir: str):
    db = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        db.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return db


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return round(value, 9) if isinstance(value, float) else str(value)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in values), key=str)


def same(spark_df, db, sql) -> None:
    want = db.sql(sql)
    assert sorted(spark_df.columns) == sorted(want.columns)
    assert rows(spark_df.columns, spark_df.collect()) == rows(want.columns, want.fetchall())
