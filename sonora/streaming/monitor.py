"""Streaming block levels and time weighting."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import numeric as N
from ..functions.acoustics import P0
from ..runtime import ship_package


#: Time constants in a span.
RANGE = 500.0


def stream_block_leq(stream: DataFrame, block: str, watermark: str, key: str = "recording") -> DataFrame:
    """Energy mean level of each recording and time block, -inf where all is silent; blocks close when the watermark passes them, later rows are dropped.

    A watermark starts in 1970, so rows before that are late.
    """
    blocks = stream.withWatermark("ts", watermark).groupBy(F.window("ts", block), key)
    energy = F.avg(F.col("p") * F.col("p"))
    level = F.when(energy == 0, -math.inf).otherwise(10 * F.log10(energy / P0**2))  # log10 of 0 is NULL in Spark
    return blocks.agg(level.alias("leq"), F.count("*").alias("n")).select(key, F.col("window.start").alias("block_start"), "leq", "n")


def stream_time_weight(stream: DataFrame, tau: float, key: str = "recording") -> DataFrame:
    """Exponentially averaged level of unevenly spaced samples; the state is the last average and time of a recording.

    Rows of a micro-batch are put in time order; rows not later than the state's time are dropped.
    """
    ship_package(stream.sparkSession)

    def run(name: tuple, batches: Iterable[pd.DataFrame], state: GroupState):
        y, last = state.get if state.exists else (math.nan, -math.inf)
        rows = pd.concat(list(batches)).sort_values("t", kind="stable").drop_duplicates("t")
        rows = rows[rows["t"] > last]
        out = N.uneven_average(rows["t"].to_numpy(float), rows["p"].to_numpy(float) ** 2, tau, y, last)
        if len(out):
            state.update((float(out[-1]), float(rows["t"].iloc[-1])))
        yield pd.DataFrame({key: [name[0]] * len(out), "t": rows["t"].to_numpy(float), "level": 10 * np.log10(np.maximum(out, 1e-30) / P0**2)})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, t double, level double", "y double, last double", "append", GroupStateTimeout.NoTimeout)


def batch_time_weight(df: DataFrame, tau: float, key: str = "recording") -> DataFrame:
    """The same recursion over a whole table, for checks and back-fills; of rows at one time the least pressure counts.

    Recordings are cut in spans of RANGE time constants, one window partition each, averaged from their first
    sample; a span then starts from the end of the one before it, by the true gap. No Python runs.
    """
    span = RANGE * tau
    rows = df.groupBy(key, "t").agg(F.min("p").alias("p")).withColumn("_span", F.floor(F.col("t") / span))
    own = W.Window.partitionBy(key, "_span").orderBy("t")
    x, since = F.col("p") * F.col("p"), lambda a, b: F.exp((a - b) / tau)
    rows = rows.withColumn("_t0", F.min("t").over(W.Window.partitionBy(key, "_span"))).withColumn("_gap", F.col("t") - F.lag("t").over(own))
    grown = F.coalesce(-F.expm1(-F.col("_gap") / tau) * x * since(F.col("t"), F.col("_t0")), F.lit(0.0))
    rows = rows.withColumn("_y", F.sum(grown).over(own.rowsBetween(W.Window.unboundedPreceding, 0)) * since(F.col("_t0"), F.col("t")))
    spans = rows.groupBy(key, "_span").agg(F.min("t").alias("t0"), F.min_by(x, "t").alias("x0"), F.max("t").alias("t1"), F.max_by("_y", "t").alias("y1"))
    # a span's start: its first sample, averaged with the end of the span before; the last two spans hold all that is left
    before = F.collect_list(F.struct("t0", "x0", "t1", "y1")).over(W.Window.partitionBy(key).orderBy("_span").rowsBetween(-3, 0))
    begin = lambda s, c: F.when(s["t1"].isNull(), c["x0"]).otherwise(c["x0"] + (s["y"] - c["x0"]) * since(s["t1"], c["t0"]))
    none = F.struct(F.lit(None).cast("double").alias("t1"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("start"))
    step = lambda s, c: F.struct(c["t1"].alias("t1"), (c["y1"] + begin(s, c) * since(c["t0"], c["t1"])).alias("y"), begin(s, c).alias("start"))
    starts = spans.withColumn("_l", before).select(key, "_span", F.aggregate("_l", none, step)["start"].alias("_start"))
    level = 10 * F.log10(F.greatest(F.col("_y") + F.col("_start") * since(F.col("_t0"), F.col("t")), F.lit(1e-30)) / P0**2)
    return rows.join(starts, [key, "_span"]).select(key, "t", level.alias("level"))
