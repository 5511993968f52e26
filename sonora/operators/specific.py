"""Time-by-band sound quality: loudness, tonality, sharpness, roughness and differences against ambient sound."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import constants as C
from ..functions.acoustics import POWER
from .sequences import in_chunks
from .stats import exact_quantiles

STEP = ("recording", "channel", "t_idx")


def band_table(spark: SparkSession) -> DataFrame:
    """band, bark, f (Hz) and per-band constants of the 53 half-Bark bands; fixed size."""
    rows = []
    for i in range(53):
        f = 81.9289 / 0.1618 * math.sinh(0.1618 * (i + 1) / 2)
        snr_db = -3.0 if f >= 1000 else sum(c * math.log10(f) ** (4 - k) for k, c in enumerate(C.MASKED))
        snr = 10 ** (snr_db / 10)
        share = snr / (1 + snr)
        rows.append((i, (i + 1) / 2, f, C.QUIET[i], 0.25 + 0.1 * share, 1.5 + 1.3 * share))
    return spark.createDataFrame(rows, "band int, bark double, f double, quiet double, compress double, response double")


def band_integrate(spec: DataFrame, dz: float = 0.5, keys: Sequence[str] = STEP) -> DataFrame:
    """Sum over bands times the band width, for each time step."""
    return spec.groupBy(*keys).agg((F.sum("value") * dz).alias("value"))


def binaural_combine(spec: DataFrame) -> DataFrame:
    """sqrt((L**2 + R**2) / 2) for each time and band that both channels have."""
    both = spec.groupBy("recording", "t_idx", "band").agg(F.sum(F.col("value") * F.col("value")).alias("s"), F.count("*").alias("n"))
    return both.filter("n = 2").select("recording", "t_idx", "band", F.sqrt(F.col("s") / 2).alias("value"))


def power_average(value: Column) -> Column:
    """Aggregate: mean of powers 1/log10(2), back to the power log10(2)."""
    return F.pow(F.avg(F.pow(value, F.lit(POWER))), F.lit(1 / POWER))


def percentile_exceeded(curve: DataFrame, percents: Sequence[int], keys: Sequence[str] = ("recording", "channel")) -> DataFrame:
    """Values exceeded so many percent of the steps, then the larger channel."""
    each = exact_quantiles(curve, keys, "value", [(100 - x) / 100 for x in percents], "_p")
    return each.groupBy(keys[0]).agg(*[F.max(F.get("_p", F.lit(i))).alias(f"ex{x}") for i, x in enumerate(percents)])


def tonality_curve(spec: DataFrame, keys: Sequence[str] = STEP) -> DataFrame:
    """For each step the largest band value, its band (the lowest of equals) and the integrated variant."""
    best = F.max(F.struct("value", (-F.col("band")).alias("b")))
    return spec.groupBy(*keys).agg(best.alias("m"), (F.sum("value") * 0.348088948583815 * 0.5).alias("integrated")).select(*keys, F.col("m.value").alias("tonality"), (-F.col("m.b")).alias("band"), "integrated")


def tonality_average(curve: DataFrame, threshold: float = 0.02) -> DataFrame:
    """Mean and 5 %-exceeded value of both variants over steps whose largest band value passes the threshold; NULL without any."""
    on = F.col("tonality") > threshold
    stats = [f(F.when(on, F.col(c))).alias(n) for c, m, x in (("tonality", "mean_max", "ex5_max"), ("integrated", "mean_int", "ex5_int")) for n, f in ((m, F.avg), (x, lambda v: F.percentile(v, F.lit(0.95))))]
    return curve.groupBy("recording", "channel").agg(*stats, F.sum(on.cast("long")).alias("n_steps"))


def tonal_annoyance_weight(spec: DataFrame) -> DataFrame:
    """Values times 1 below 1 kHz and 2.3 (log10 f - 3) + 1 above."""
    bands = F.broadcast(band_table(spec.sparkSession).select("band", "f"))
    weight = F.when(F.col("f") < 1000, 1.0).otherwise(2.3 * (F.log10("f") - 3) + 1)
    return spec.join(bands, "band").withColumn("value", F.col("value") * weight).drop("f")


def combine_tonal_noise_loudness(tonal: DataFrame, noise: DataFrame) -> DataFrame:
    """(T**e + (0.5331 N)**e)**(1/e), where e falls with the step's largest sum of both."""
    both = tonal.withColumnRenamed("value", "t").join(noise.withColumnRenamed("value", "n"), [*STEP, "band"])
    top = both.groupBy(*STEP).agg(F.max(F.col("t") + F.col("n")).alias("top"))
    e = 0.2918 / (F.col("top") + 1e-12) + 0.5459
    value = F.pow(F.pow("t", F.col("e")) + F.pow(0.5331 * F.col("n"), F.col("e")), 1 / F.col("e"))
    return both.join(top.select(*STEP, e.alias("e")), list(STEP)).select(*STEP, "band", value.alias("value"))


def scale_tonality(tonal: DataFrame, noise: DataFrame) -> DataFrame:
    """Tonal loudness times a saturating function of the step's signal-to-noise ratio, floored at 0."""
    steps = tonal.groupBy(*STEP).agg(F.max("value").alias("peak")).join(noise.groupBy(*STEP).agg(F.sum("value").alias("floor")), list(STEP))
    drop = F.exp(-35 * (F.col("peak") / (F.col("floor") + 1e-12) - 0.003))
    q = steps.select(*STEP, F.when(drop >= 1, 0.0).otherwise(1 - drop).alias("q"))
    return tonal.join(q, list(STEP)).select(*STEP, "band", (F.col("value") * F.col("q") * 2.8758615 / 0.9999043734252).alias("value"))


def block_rms(frames: DataFrame, keys: Sequence[str], value: str = "p") -> DataFrame:
    """Half-wave rectified RMS of each block: sqrt(2/N sum of squares of the positive samples)."""
    positive = F.greatest(F.col(value), F.lit(0.0))
    return frames.groupBy(*keys).agg(F.sqrt(2 * F.sum(positive * positive) / F.count("*")).alias("rms"))


def band_loudness(rms: Column) -> Column:
    """Loudness of a block's RMS by the compressive non-linearity of eight thresholds."""
    out = C.LOUDNESS_CAL * C.LOUDNESS_CALX * rms / 2e-5
    for i in range(8):
        threshold = 2e-5 * 10 ** ((15 + 10 * i) / 20)
        out = out * F.pow(1 + F.pow(rms / threshold, F.lit(C.LOUDNESS_ALPHA)), F.lit((C.LOUDNESS_V[i + 1] - C.LOUDNESS_V[i]) / C.LOUDNESS_ALPHA))
    return out


def basis_loudness(rms: DataFrame) -> DataFrame:
    """rms: band, rms and any keys. Loudness above the band's threshold in quiet, not below 0."""
    quiet = F.broadcast(band_table(rms.sparkSession).select("band", "quiet"))
    return rms.join(quiet, "band").withColumn("loudness", F.greatest(band_loudness(F.col("rms")) - F.col("quiet"), F.lit(0.0))).drop("quiet")


def partial_loudness(target: DataFrame, masker: DataFrame, keys: Sequence[str], sample: str = "pos") -> DataFrame:
    """Loudness of a target heard in a masker, for blocks of samples (keys, band, sample, p) of both.

    Both loudnesses are decompressed, the masker's share is subtracted and damped, and the rest is
    compressed again; nothing is left where the sum of both signals is below the threshold in quiet.
    """
    both = target.withColumnRenamed("p", "t").join(masker.withColumnRenamed("p", "m"), [*keys, "band", sample])
    positive = lambda x: F.pow(F.greatest(x, F.lit(0.0)), F.lit(2.0))
    rms = lambda x: F.sqrt(2 * F.sum(positive(x)) / F.count("*"))
    blocks = both.groupBy(*keys, "band").agg(rms(F.col("t")).alias("t"), rms(F.col("m")).alias("m"), rms(F.col("t") + F.col("m")).alias("s"))
    rows = blocks.join(F.broadcast(band_table(target.sparkSession)), "band").select(*keys, "band", "quiet", "compress", "response", *[band_loudness(F.col(c)).alias(c) for c in "tms"])
    t, m = F.pow("t", 1 / F.col("compress")), F.pow("m", 1 / F.col("compress"))
    ratio = F.greatest((t - 0.5 * m) / (t + m + 1e-12), F.lit(0.0))
    left = F.pow(F.pow(ratio, F.col("response")) * t, F.col("compress"))
    value = F.when(F.col("s") <= F.col("quiet"), 0.0).otherwise(F.greatest(left - F.col("quiet"), F.lit(0.0)))
    return rows.select(*keys, "band", value.alias("value"))


#: Fixed calibration constants of sharpness from half-Bark loudness.
SHARPNESS = {"aures": 1.064337788536963, "vonbismarck": 0.983923859575781, "widmann": 0.985397109771378}
_WEIGHTS = {"vonbismarck": (15.0, 0.2, 0.308, 0.8), "widmann": (15.8, 0.15, 0.42, 0.85)}


def sharpness_curve(spec: DataFrame, method: str = "widmann", calibration: float | None = None, dz: float = 0.5, keys: Sequence[str] = STEP) -> DataFrame:
    """Sharpness of each step; 0 where the loudness is 0. spec: keys, band (Bark = (band + 1) dz), value."""
    cal = 0.11 * (SHARPNESS[method] if calibration is None else calibration)
    z = (F.col("band") + 1) * dz
    if method == "aures":
        weight = 0.078 * F.exp(0.171 * z)
        steps = spec.groupBy(*keys).agg((F.sum("value") * dz).alias("n"), F.sum(F.col("value") * weight * dz).alias("s"))
        value = cal * F.col("s") / (F.log(0.05 * F.col("n") + 1) + 2.0**-52)
    else:
        q1, q2, q3, q4 = _WEIGHTS[method]
        weight = F.when(z >= q1, q2 * F.exp(q3 * (z - q1)) + q4).otherwise(1.0)
        steps = spec.groupBy(*keys).agg((F.sum("value") * dz).alias("n"), F.sum(F.col("value") * weight * z * dz).alias("s"))
        value = cal * F.col("s") / (F.col("n") + 2.0**-52)
    return steps.select(*keys, F.when(F.col("n") == 0, 0.0).otherwise(value).alias("value"))


def roughness_transform(spec: DataFrame, calibration: float = 1.0, keys: Sequence[str] = STEP) -> DataFrame:
    """calibration times values to a power that depends on how uneven the step's bands are; estimates below 0 count as 0."""
    spec = spec.withColumn("value", F.greatest(F.col("value"), F.when(F.col("value").isNotNull(), 0.0)))
    steps = spec.groupBy(*keys).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.avg("value").alias("mean"))
    b = F.when(F.col("mean") == 0, 0.0).otherwise(F.col("rms") / F.col("mean"))
    e = steps.select(*keys, ((0.95555 - 0.58449) * (F.tanh(1.6407 * (b - 2.5804)) + 1) * 0.5 + 0.58449).alias("e"))
    return spec.join(e, list(keys)).select(*keys, "band", (calibration * F.pow("value", F.col("e"))).alias("value"))


def moving_average(df: DataFrame, n: int, keys: Sequence[str] = ("recording", "channel", "band"), order: str = "t_idx") -> DataFrame:
    """Trailing mean of n steps, NULL until there are n."""
    w = W.Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    return df.withColumn("value", F.when(F.count("value").over(w) == n, F.avg("value").over(w)))


def positive_difference(combined: DataFrame, ambient: DataFrame, n: int, ambient_id: str = "ambient_id") -> DataFrame:
    """max(combined - ambient, 0) after a trailing mean of n steps on both, by time step, channel and band.

    combined: recording, ambient_id, channel, t_idx, band, value; ambient: recording, channel, t_idx, band,
    value. Ambient recordings are few and shared by many, a skewed key that adaptive joins split.
    """
    a = moving_average(ambient, n).select(F.col("recording").alias(ambient_id), "channel", "t_idx", "band", F.col("value").alias("_base"))
    c = moving_average(combined, n, ("recording", "channel", "band"))
    return c.join(a, [ambient_id, "channel", "t_idx", "band"]).withColumn("value", F.greatest(F.col("value") - F.col("_base"), F.when(F.col("_base").isNotNull(), 0.0))).drop("_base")


def band_smooth(spec: DataFrame, keys: Sequence[str] = STEP) -> DataFrame:
    """Mean of a band and both neighbours; the first and last band stay."""
    w = W.Window.partitionBy(*keys).orderBy("band")
    three = w.rowsBetween(-1, 1)
    return spec.withColumn("value", F.when(F.count("*").over(three) == 3, F.avg("value").over(three)).otherwise(F.col("value")))


def impulsive_loudness(curve: DataFrame, half: int, percent: float = 5.0, keys: Sequence[str] = ("recording", "channel"), chunk: int = 65_536) -> DataFrame:
    """Adds base (a low percentile of the steps within half on either side, fewer at the ends) and impulse, the excess over it.

    Chunks with their neighbours' rows are rolled over by an ordered buffer, so a step costs log(half) and not half.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["t_idx"].to_numpy()
        values = pdf.set_index("t_idx")["value"].reindex(np.arange(at[0], at[-1] + 1))  # steps that lack hold nothing
        base = values.rolling(2 * half + 1, center=True, min_periods=1).quantile(percent / 100)
        return pdf.assign(base=base.reindex(at).to_numpy())

    out = in_chunks(curve, keys, "t_idx", chunk, half, half, run, "base double")
    return out.withColumn("impulse", F.greatest(F.col("value") - F.col("base"), F.lit(0.0)))


def impulsive_summary(curve: DataFrame, keys: Sequence[str] = ("recording", "channel")) -> DataFrame:
    """Mean and power average of the impulse column."""
    return curve.groupBy(*keys).agg(F.avg("impulse").alias("impulse_mean"), power_average(F.col("impulse")).alias("impulse_power"))
