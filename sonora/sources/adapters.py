"""Adapter views: the generic tables read as sound pressure, band values, ratings and people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Samples a second of the signals view.
RATE = 8
BANDS = 53


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, channel, sample_idx, p: events of a user in time order, odd and even ids as two channels."""
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 2).cast("int").alias("channel"), "ts", "event_id", "value")
    order = W.Window.partitionBy("user_id", "channel").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("recording"), "channel", (F.row_number().over(order) - 1).cast("long").alias("sample_idx"), ((F.col("value") - 20.0) / 1000.0).alias("p"))


def spec_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, channel, t_idx, values: vectors of a label in order, taken in turn as left and right."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    rn = F.row_number().over(W.Window.partitionBy("label").orderBy("vec_id"))
    e = e.withColumn("rn", rn)
    return e.select(F.col("label").alias("recording"), ((F.col("rn") - 1) % 2).cast("int").alias("channel"), F.floor((F.col("rn") - 1) / 2).cast("int").alias("t_idx"), F.col("embedding").alias("values"))


def spec_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, channel, t_idx, band (0 to 52), value (not negative)."""
    rows = spec_rows(spark, sf_dir)
    return rows.select("recording", "channel", "t_idx", F.posexplode(F.slice("values", 1, BANDS)).alias("band", "e")).select("recording", "channel", "t_idx", "band", (F.greatest(F.col("e").cast("double"), F.lit(0.0)) * 10.0).alias("value"))


def third_octaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, channel, t_idx, band (0 to 30), level_db."""
    rows = spec_rows(spark, sf_dir)
    return rows.select("recording", "channel", "t_idx", F.posexplode(F.slice("values", 1, 31)).alias("band", "e")).select("recording", "channel", "t_idx", "band", (60.0 + 40.0 * F.col("e").cast("double")).alias("level_db"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """participant, ambient, lvl, stimulus, rating, trial_key: order lines as ratings of a customer; line 1 is the baseline."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linenumber", "l_quantity", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    first = W.Window.partitionBy("o_custkey", "l_returnflag", "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    stimulus = F.when(F.col("l_linenumber") == 1, F.concat("l_returnflag", F.lit("_Baseline"))).otherwise(F.concat("l_returnflag", F.lit("_S"), F.col("l_linenumber").cast("string")))
    return rows.select(F.col("o_custkey").alias("participant"), F.col("l_returnflag").alias("ambient"), F.col("l_linenumber").alias("lvl"), stimulus.alias("stimulus"), (F.col("l_quantity") % 11).cast("double").alias("rating"), F.col("l_orderkey").alias("trial_key"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """participant, attitude, nation, age (missing where the balance is negative)."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("participant"), F.col("c_mktsegment").alias("attitude"), F.col("c_nationkey").alias("nation"), F.when(F.col("c_acctbal") >= 0, F.floor(18 + F.col("c_acctbal") % 60)).cast("long").alias("age"))


#: The same views as common table expressions.
VIEWS = """
signals AS (SELECT user_id AS recording, CAST(event_id % 2 AS INT) AS channel,
  ROW_NUMBER() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) - 1 AS sample_idx, (value - 20.0e0) / 1000.0e0 AS p FROM events),
spec_rows AS (SELECT label AS recording, CAST((rn - 1) % 2 AS INT) AS channel, CAST(floor((rn - 1) / 2.0e0) AS INT) AS t_idx, embedding
  FROM (SELECT label, embedding, ROW_NUMBER() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) x),
spec_long AS (SELECT recording, channel, t_idx, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS band FROM spec_rows),
spec_metric AS (SELECT recording, channel, t_idx, CAST(band AS INT) AS band, greatest(CAST(e AS DOUBLE), 0.0e0) * 10.0e0 AS value FROM spec_long WHERE band < 53),
thirds AS (SELECT recording, channel, t_idx, CAST(band AS INT) AS band, 60.0e0 + 40.0e0 * CAST(e AS DOUBLE) AS level_db FROM spec_long WHERE band < 31),
ratings AS (SELECT participant, ambient, lvl, CASE WHEN lvl = 1 THEN ambient || '_Baseline' ELSE ambient || '_S' || CAST(lvl AS VARCHAR) END AS stimulus, rating, trial_key
  FROM (SELECT o_custkey AS participant, l_returnflag AS ambient, l_linenumber AS lvl, CAST(l_quantity % 11 AS DOUBLE) AS rating, l_orderkey AS trial_key,
    ROW_NUMBER() OVER (PARTITION BY o_custkey, l_returnflag, l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x WHERE rn = 1),
people AS (SELECT c_custkey AS participant, c_mktsegment AS attitude, c_nationkey AS nation, CASE WHEN c_acctbal >= 0 THEN CAST(floor(18 + c_acctbal % 60) AS BIGINT) END AS age FROM customer)
"""
