"""Fractional-octave bands, narrow-band bins, phon and sone, detectability, annoyance over time."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.acoustics import P0, power_from_level, psych_annoyance
from .specific import power_average

#: Preferred frequencies of one decade.
PREFERRED = [1.0, 1.25, 1.6, 2.0, 2.5, 3.15, 4.0, 5.0, 6.3, 8.0]


def octave_bands(spark: SparkSession, low: float, high: float, n: int = 3) -> DataFrame:
    """band, f_mid, f_low, f_high of the bands nearest to low up to the one nearest to high."""
    g, at = 10**0.3, lambda i: (i if n % 2 else i + 0.5) / n
    index = range(-15 * n, 15 * n + 1)
    mids = {i: 1000 * g ** at(i) for i in index}
    first, last = (min(index, key=lambda i: abs(mids[i] - f)) for f in (low, high))
    edge = g ** (0.5 / n)
    return spark.createDataFrame([(i - first, mids[i], mids[i] / edge, mids[i] * edge) for i in range(first, last + 1)], "band int, f_mid double, f_low double, f_high double")


def nominal_bands(spark: SparkSession, low: float, high: float, n: int = 3) -> DataFrame:
    """octave_bands with the nearest preferred frequency of each mid frequency."""
    preferred = spark.createDataFrame([(p * 10.0**d,) for d in range(0, 6) for p in PREFERRED], "f_nominal double")
    bands = octave_bands(spark, low, high, n)
    near = bands.join(F.broadcast(preferred), (F.col("f_nominal") > F.col("f_mid") / 1.3) & (F.col("f_nominal") < F.col("f_mid") * 1.3))
    return near.groupBy("band", "f_mid", "f_low", "f_high").agg(F.min_by("f_nominal", F.abs(F.col("f_nominal") - F.col("f_mid"))).alias("f_nominal"))


def bins_to_bands(spectrum: DataFrame, bands: DataFrame, keys: Sequence[str] = ("recording", "channel")) -> DataFrame:
    """Energy of the narrow-band bins (freq, power) that fall into each band [f_low, f_high), as a level. The band table is of fixed size."""
    rows = spectrum.join(F.broadcast(bands), (F.col("freq") >= F.col("f_low")) & (F.col("freq") < F.col("f_high")))
    return rows.groupBy(*keys, "band").agg((10 * F.log10(F.sum("power") / P0**2)).alias("level_db"))


def _interpolated(df: DataFrame, col: str, out: str, xs: Sequence[float], ys: Sequence[float]) -> DataFrame:
    """Piecewise linear with linear extrapolation, by the segment that holds the value (a table of fixed size)."""
    rows = [(None if i == 0 else float(a), None if i == len(xs) - 2 else float(b), float(a), float(ya), float((yb - ya) / (b - a))) for i, (a, b, ya, yb) in enumerate(zip(xs, xs[1:], ys, ys[1:], strict=False))]
    table = df.sparkSession.createDataFrame(rows, "_lo double, _hi double, _x double, _y double, _slope double")
    inside = (F.col("_lo").isNull() | (F.col(col) >= F.col("_lo"))) & (F.col("_hi").isNull() | (F.col(col) < F.col("_hi")))
    return df.join(F.broadcast(table), inside, "left").withColumn(out, F.col("_y") + (F.col(col) - F.col("_x")) * F.col("_slope")).drop("_lo", "_hi", "_x", "_y", "_slope")


def phon_to_sone(df: DataFrame, col: str, out: str = "sone") -> DataFrame:
    return _interpolated(df, col, out, C.PHON, C.SONE)


def sone_to_phon(df: DataFrame, col: str, out: str = "phon") -> DataFrame:
    """0 sone is -Infinity phon."""
    return _interpolated(df, col, out, C.SONE, C.PHON).withColumn(out, F.when(F.col(col) == 0, F.lit(float("-inf"))).otherwise(F.col(out)))


def detect_table(spark: SparkSession, step: float) -> DataFrame:
    """band, efficiency, noise (equivalent auditory noise power), a_weight of the 31 third octaves; fixed size."""
    g, rows = 10**0.3, []
    for i in range(31):
        f = 1000 * g ** ((i - 17) / 3)
        width = f * (g ** (1 / 6) - g ** (-1 / 6))
        erb = 24.7 * (1 + 4.37 / 1000 * f)
        kick = -6 * math.log10(f / 2500) ** 2 if f >= 2500 else 0.0
        efficiency = 0.3 * math.sqrt(step) * math.sqrt(width) * math.sqrt(width / erb) * 10 ** (kick / 10)
        rows.append((i, efficiency, efficiency * (P0 * 10 ** (C.HEARING_THRESHOLDS[i] / 20)) ** 2 / 2, C.A_WEIGHTS[i]))
    return spark.createDataFrame(rows, "band int, efficiency double, noise double, a_weight double")


def detectability_spectrum(target: DataFrame, masker: DataFrame, step: float = 0.5, keys: Sequence[str] = ("recording", "channel", "t_idx")) -> DataFrame:
    """d' of the target in the masker, discount and discounted level of each time and band (level_db in both), and the A-weighted levels."""
    both = target.select(*keys, "band", F.col("level_db").alias("target_db")).join(masker.select(*keys, "band", F.col("level_db").alias("masker_db")), [*keys, "band"])
    rows = both.join(F.broadcast(detect_table(target.sparkSession, step)), "band")
    power = lambda c: P0**2 * power_from_level(F.col(c))
    rows = rows.withColumn("d_prime", F.col("efficiency") * power("target_db") / (power("masker_db") + F.col("noise"))).withColumn("discount_db", 3 / (F.col("d_prime") / 14))
    return rows.withColumn("discounted_db", F.col("target_db") - F.col("discount_db")).select(*keys, "band", "target_db", "masker_db", "a_weight", "d_prime", "discount_db", "discounted_db", *[(F.col(f"{c}_db") + F.col("a_weight")).alias(f"{c}_dba") for c in ("target", "masker", "discounted")])


def detectability_summary(spectrum: DataFrame, step: float = 0.5, skip: tuple[int, int] = (0, 0), keys: Sequence[str] = ("recording", "channel")) -> DataFrame:
    """Largest, integrated and median detectability (dB), A-weighted mean and exposure levels of target, masker and discounted target, and the discount.

    First over bands (largest, and root of the sum of squares), then over the time steps that are left after skip at both ends.
    """
    power = lambda c: F.sum(power_from_level(F.col(c)))
    steps = spectrum.groupBy(*keys, "t_idx").agg(F.max("d_prime").alias("top"), F.sqrt(F.sum(F.pow("d_prime", F.lit(2.0)))).alias("both"), *[power(f"{c}_dba").alias(c) for c in ("target", "masker", "discounted")])
    ends = steps.groupBy(*keys).agg(F.min("t_idx").alias("_a"), F.max("t_idx").alias("_b"))
    steps = steps.join(ends, list(keys)).filter((F.col("t_idx") >= F.col("_a") + skip[0]) & (F.col("t_idx") <= F.col("_b") - skip[1]))
    db = lambda x: 10 * F.log10(x)
    half = F.lit(0.5)
    out = steps.groupBy(*keys).agg(db(F.max("top")).alias("max_db"), db(F.max("both")).alias("int_max_db"), db(step * F.sum("both")).alias("int_db"), db(step * F.sum("top")).alias("max_int_db"), F.percentile(db(F.col("top")), half).alias("max_ex50"), F.percentile(db(F.col("both")), half).alias("int_ex50"), *[db(F.avg(c)).alias(f"laeq_{c}") for c in ("target", "masker", "discounted")], *[db(step * F.sum(c)).alias(f"lae_{c}") for c in ("target", "masker")])
    out = out.withColumn("dba_discount", F.col("laeq_target") - F.col("laeq_discounted"))
    return out.withColumn("lae_discounted", F.col("lae_target") - F.col("dba_discount"))


def psych_annoyance_curve(loud: DataFrame, sharp: DataFrame, fluct: DataFrame, rough: DataFrame, key: str | Sequence[str] = "recording") -> DataFrame:
    """Annoyance of each step of curves (key columns, t_idx, value) on one time grid."""
    keys = [key] if isinstance(key, str) else list(key)
    rows = loud.select(*keys, "t_idx", F.col("value").alias("loud"))
    for name, df in (("sharp", sharp), ("fluct", fluct), ("rough", rough)):
        rows = rows.join(df.select(*keys, "t_idx", F.col("value").alias(name)), [*keys, "t_idx"])
    pa = psych_annoyance("widmann", F.col("loud"), F.col("sharp"), F.col("rough"), F.col("fluct"))
    return rows.select(*keys, "t_idx", F.when(F.col("loud") > 0, pa).otherwise(0.0).alias("value"))


def psych_annoyance_overall(loud: DataFrame, sharp: DataFrame, fluct: DataFrame, rough: DataFrame, keys: Sequence[str] = ("recording",), form: str = "percentiles") -> DataFrame:
    """Annoyance of whole recordings from curves (key columns, value), each at a rate of its own.

    "percentiles": from the values exceeded 5 % of the time. "averages": from the power averages of loudness
    and sharpness, and the values of fluctuation and roughness exceeded 10 % of the time.
    """
    exceeded = lambda x: lambda c: F.percentile(c, F.lit(1 - x / 100))
    of = [exceeded(5)] * 4 if form == "percentiles" else [power_average, power_average, exceeded(10), exceeded(10)]
    out = None
    for name, df, f in zip(("loud", "sharp", "fluct", "rough"), (loud, sharp, fluct, rough), of, strict=True):
        one = df.groupBy(*keys).agg(f(F.col("value")).alias(name))
        out = one if out is None else out.join(one, list(keys))
    pa = psych_annoyance("widmann", F.col("loud"), F.col("sharp"), F.col("rough"), F.col("fluct"))
    return out.select(*keys, F.when(F.col("loud") > 0, pa).otherwise(0.0).alias("annoyance"))
