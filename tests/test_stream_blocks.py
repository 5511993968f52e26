"""The events stream reads whole tables, as a file or in a folder, and equals its SQL on silent, old and missing rows."""

import math

import duckdb
import pytest
from sqlcheck import same

from sonora import plans

ROWS = """(1, '2024-01-01 00:00:00', 1, 20.0e0), (2, '2024-01-02 05:00:00', 1, 20.0), (3, '2024-01-02 06:00:00', 1, 21.0),
(4, '1965-03-01 12:00:00', 1, 25.0), (5, '1969-12-31 23:59:59.999999', 2, 20.0), (6, NULL, 1, 5.0), (7, '2024-01-02 05:00:00', NULL, 30.0),
(8, '2024-01-02 06:00:00', 3, NULL), (9, '2024-01-02 07:00:00', 4, 'nan'), (10, '2024-01-03 00:30:00', 4, 22.0), (11, '2024-01-04 00:59:59.999999', 4, 23.0)"""


@pytest.fixture(params=["events.parquet", "events.parquet/part-{}.parquet", "events.parquet/kind={}/part.parquet"])
def events(request, tmp_path):
    """A folder whose events are a file, files in a folder, or files in folders of a column; another table and a file of a like name lie beside it."""
    db, file = duckdb.connect(), f"{tmp_path}/{request.param}"
    db.sql(f"CREATE TABLE events AS SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, CAST(user_id AS BIGINT) AS user_id, CAST(value AS DOUBLE) AS value FROM (VALUES {ROWS}) t(event_id, ts, user_id, value)")
    for k in range(3 if "{}" in file else 1):
        (part := tmp_path / request.param.format(k)).parent.mkdir(parents=True, exist_ok=True)
        db.sql(f"COPY (SELECT * FROM events{f' WHERE event_id % 3 = {k}' if '{}' in file else ''}) TO '{part}' (FORMAT parquet)")
    for other in ("documents.parquet", "events.parquet.old"):
        (tmp_path / other).mkdir()
        db.sql(f"COPY (SELECT event_id, ts, user_id, 90.0 AS value FROM events) TO '{tmp_path}/{other}/part-0.parquet' (FORMAT parquet)")
    return str(tmp_path), db


def test_block_levels_equal_sql(spark, events):
    sf_dir, db = events
    got = plans.all_queries()["stream_block_leq"](spark, sf_dir)
    same(got, db, plans.all_oracles()["stream_block_leq"])
    assert [r["leq"] for r in got.filter("recording = 1 and block_start = 1704067200").collect()] == [-math.inf]
    assert got.count() == 7


def test_time_weight_reads_all_files(spark, events):
    sf_dir, db = events
    got = plans.all_queries()["stream_time_weight"](spark, sf_dir)
    same(got.select("recording", "us"), db, "SELECT user_id AS recording, epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL")
