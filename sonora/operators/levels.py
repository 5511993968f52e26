"""Sound levels of signals: statistics, blocks, intermittency, trimming, calibration, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.acoustics import P0, level_from_pressure

KEYS = ("recording", "channel")
EXCEEDED = (5, 10, 25, 50, 75, 90, 95)


def level_stats(signals: DataFrame, rate: float, keys: Sequence[str] = KEYS, p: str = "p", decimals: int = 2) -> DataFrame:
    """leq, le, lmax and L5 to L95 (exceeded so many percent of the time) of each recording and channel.

    Samples are first counted by level in steps of 10**-decimals dB, so a long recording is a short table
    of counts, and the exact percentiles are taken over these.
    """
    levels = signals.withColumn("_level", F.round(level_from_pressure(F.col(p)), decimals))
    counts = levels.groupBy(*keys, "_level").agg(F.count("*").alias("_n"), F.sum(F.col(p) * F.col(p)).alias("_energy"))
    mean = F.sum("_energy") / F.sum("_n")
    shares = F.percentile("_level", F.array(*[F.lit((100 - x) / 100) for x in EXCEEDED]), F.col("_n"))
    out = counts.groupBy(*keys).agg((10 * F.log10(mean / P0**2)).alias("leq"), F.sum("_n").alias("n"), F.max("_level").alias("lmax"), shares.alias("_l"))
    return out.select(*keys, "n", "leq", (F.col("leq") + 10 * F.log10(F.col("n") / rate)).alias("le"), "lmax", *[F.get("_l", F.lit(i)).alias(f"l{x}") for i, x in enumerate(EXCEEDED)])


def max_over_channels(df: DataFrame, values: Sequence[str], key: str = "recording") -> DataFrame:
    """The larger channel's value of each metric."""
    return df.groupBy(key).agg(*[F.max(v).alias(v) for v in values])


def block_leq(signals: DataFrame, block: int, keys: Sequence[str] = KEYS, drop_last_exact: bool = False) -> DataFrame:
    """Energy mean level of complete blocks of so many samples; with drop_last_exact a block that ends with the signal is left out, as by a window that is open on the right."""
    rows = signals.withColumn("block_idx", F.floor(F.col("sample_idx") / block))
    out = rows.groupBy(*keys, "block_idx").agg(F.avg(F.col("p") * F.col("p")).alias("energy"), F.count("*").alias("n")).filter(F.col("n") == block)
    if drop_last_exact:
        sizes = signals.groupBy(*keys).agg(F.count("*").alias("_all"))
        out = out.join(sizes, list(keys)).filter((F.col("block_idx") + 1) * block < F.col("_all"))
    return out.select(*keys, "block_idx", (10 * F.log10(F.col("energy") / P0**2)).alias("leq"))


def intermittency_ratio(signals: DataFrame, rate: int, thresholds: Sequence[float] = (2, 3, 5), keys: Sequence[str] = KEYS) -> DataFrame:
    """Share (%) of the energy in seconds louder than the whole by each threshold; 0 without such seconds; the larger channel."""
    whole = signals.groupBy(*keys).agg((10 * F.log10(F.avg(F.col("p") * F.col("p")) / P0**2)).alias("whole"), (F.count("*") / rate).alias("seconds"))
    seconds = block_leq(signals, rate, keys, drop_last_exact=True)
    rows = whole.join(seconds, list(keys), "left").select("*", F.explode(F.array(*[F.lit(float(c)) for c in thresholds])).alias("c"))
    events = F.sum(F.when(F.col("leq") > F.col("whole") + F.col("c"), F.pow(F.lit(10.0), F.col("leq") / 10)))
    each = rows.groupBy(*keys, "c").agg(F.coalesce(100 * events / F.first("seconds") / F.pow(F.lit(10.0), F.first("whole") / 10), F.lit(0.0)).alias("ratio"))
    return each.groupBy(keys[0], "c").agg(F.max("ratio").alias("intermittency"))


def skip_ends(df: DataFrame, key: Sequence[str], t: str, start_skip: float, end_skip: float) -> DataFrame:
    """Rows later than start_skip and earlier than the last time less end_skip, both strictly."""
    last = F.max(t).over(W.Window.partitionBy(*key))
    return df.withColumn("_last", last).filter((F.col(t) > start_skip) & (F.col(t) < F.col("_last") - end_skip)).drop("_last")


def calibrate(signals: DataFrame, kind: str, target: float, rate: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Scales each signal so that its leq, le (dB) or peak (Pa) is the target."""
    energy = F.avg(F.col("p") * F.col("p"))
    level = {"leq": 10 * F.log10(energy / P0**2), "le": 10 * F.log10(energy / P0**2) + 10 * F.log10(F.count("*") / rate), "peak": 20 * F.log10(F.max(F.abs("p")))}[kind]
    goal = target if kind != "peak" else F.lit(20.0) * F.log10(F.lit(float(target)))
    gain = signals.groupBy(*keys).agg(F.pow(F.lit(10.0), (goal - level) / 20).alias("_gain"))
    return signals.join(gain, list(keys)).withColumn("p", F.col("p") * F.col("_gain")).drop("_gain")


def truncate(signals: DataFrame, start: int, end: int) -> DataFrame:
    """Samples from start up to end, counted anew."""
    return signals.filter((F.col("sample_idx") >= start) & (F.col("sample_idx") < end)).withColumn("sample_idx", F.col("sample_idx") - start)


def event_runs(df: DataFrame, flag: Column, keys: Sequence[str] = KEYS, order: str = "sample_idx", mode: str = "longest") -> DataFrame:
    """First and last place of the flag ("firstlast"), or of its longest run, the first of equals ("longest")."""
    rows = df.select(*keys, F.col(order).alias("_at"), flag.alias("_flag"))
    if mode == "firstlast":
        return rows.filter("_flag").groupBy(*keys).agg(F.min("_at").alias("start"), F.max("_at").alias("end"))
    by_key = W.Window.partitionBy(*keys).orderBy("_at")
    numbered = rows.withColumn("_n", F.row_number().over(by_key)).filter("_flag")
    runs = numbered.withColumn("_run", F.col("_n") - F.row_number().over(by_key)).groupBy(*keys, "_run").agg(F.min("_at").alias("start"), F.max("_at").alias("end"), F.count("*").alias("n"))
    best = W.Window.partitionBy(*keys).orderBy(F.desc("n"), "start")
    return runs.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select(*keys, "start", "end", "n")
