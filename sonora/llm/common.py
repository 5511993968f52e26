"""What the operators share: word patterns, checkpoints, ranks and sums that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..runtime import checkpoint_folder

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a few numbers that a checkpoint's file takes.
ROWS_A_FILE = 50_000
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def files(rows: int) -> int:
    return rows // ROWS_A_FILE + 1


def settled(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The same rows, written to the shared checkpoint folder: computed once, and not lost with an executor.

    rows: about how many there are, of a few numbers each, where that is known: they are dealt evenly to as many files
    as they fill. Otherwise every partition makes a file, and on a local file system each file takes two processes that
    the executor starts (Hadoop's chmod); tables of a few rows would make as many as large ones.
    """
    checkpoint_folder(df.sparkSession)
    return (df if rows is None else df.repartition(files(rows))).checkpoint()


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; lower() does the same, and faster, where all characters are ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, keys: list[str], order: list[str], n_rows: int, out: str = "rank", rows_per_bucket: int = 50_000, buckets: int | None = None) -> DataFrame:
    """Adds a gapless 0-based rank within each group of keys (non-null columns).

    The rows of a group are dealt into hash buckets of `order`; a bucket's first rank is the
    number of rows in the buckets before it, so no task holds a whole group, however large.
    Rows that tie in all of `order` get ranks of their own in any order.
    """
    buckets = buckets or max(1, n_rows // rows_per_bucket + 1)
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    within = W.Window.partitionBy(*keys, "_bucket").orderBy(*order)
    if buckets == 1:
        return df.withColumn(out, (F.row_number().over(within) - 1).cast("long")).drop("_bucket")
    before = W.Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    first = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return df.withColumn("_row", F.row_number().over(within) - 1).join(first, [*keys, "_bucket"]).withColumn(out, (F.col("_row") + F.col("_first")).cast("long")).drop("_bucket", "_row", "_first")
