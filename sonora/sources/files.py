"""Readers and writers of response files, matrices and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_response_csvs(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """Rows of many CSV files of one schema, with the file they come from."""
    return spark.read.schema(schema).csv(paths, header=True).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_spec_matrix(spark: SparkSession, path: str, sep: str = "\t", name: str = r"([^/]+)$") -> DataFrame:
    """source_file (what the pattern `name` finds in the path), t, band, value of text matrices whose first row holds bands and first column times.

    Each file's first row is found by its blank or NaN first cell, and joined to the other rows by file and
    place in the row; only the header rows (one a file) are broadcast.
    """
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), name, 1).alias("source_file"), F.split("value", sep).alias("cells"))
    first = F.trim(F.element_at("cells", 1))
    header = (first == "") | (F.lower(first) == "nan") | (first == "0") & (F.size("cells") > 1) & F.element_at("cells", 2).isin("0.5")
    axis = lines.filter(header).select("source_file", F.posexplode("cells").alias("place", "band")).filter("place > 0")
    body = lines.filter(~header).select("source_file", first.cast("double").alias("t"), F.posexplode("cells").alias("place", "value")).filter("place > 0")
    return body.join(axis, ["source_file", "place"]).select("source_file", "t", F.trim("band").cast("double").alias("band"), F.trim("value").cast("double").alias("value"))


def write_tables(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Writes a result as Parquet or CSV, in folders by the partition columns."""
    writer = df.write.mode(mode).format(fmt).partitionBy(*partition_by)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def parse_file_facets(df: DataFrame, col: str) -> DataFrame:
    """Adds stem, suffix and host-like first part of a file name or address; NULL where there is none."""
    name = F.element_at(F.split(F.regexp_replace(F.col(col), r"[?#].*$", ""), "/"), -1)
    none = lambda c: F.when(c != "", c)
    return df.withColumn("stem", none(F.regexp_replace(name, r"\.[^.]*$", ""))).withColumn("rendering", none(F.regexp_extract(F.col(col), r"^[a-z]+://([^/]+)", 1))).withColumn("kind", none(F.regexp_extract(F.col(col), r"/(en|de|fr|es)/", 1)))
