"""Ordered work inside recordings: frames, spectra, filters, interpolation, resampling statistics."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import numeric as N
from ..runtime import ship_package
from .stats import _settled, order_counts

KEYS = ("recording", "channel")


def _types(df: DataFrame, cols: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in cols)


def frame_blocks(signals: DataFrame, block: int, overlap: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """block_idx and frame (an array of samples) of complete overlapping blocks. Each sample is dealt to the blocks that cover it, and a block is one row."""
    hop = max(1, int(block * (1 - overlap)))
    i = F.col("sample_idx")
    first = F.greatest(F.ceil((i - (block - 1)) / hop), F.lit(0).cast("long"))
    rows = signals.select(*keys, "sample_idx", "p", F.explode(F.sequence(first, F.floor(i / hop))).alias("block_idx"))
    frames = rows.groupBy(*keys, "block_idx").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "p"))).alias("_f"))
    return frames.filter(F.size("_f") == block).select(*keys, "block_idx", F.transform("_f", lambda x: x["p"]).alias("frame"))


def _spectra(frames: DataFrame, rate: float, keys: Sequence[str], window: Callable[[int], np.ndarray]) -> DataFrame:
    ship_package(frames.sparkSession)

    def run(batches):
        for pdf in batches:
            out = pdf[[*keys, "block_idx"]].copy()
            out["power"] = list(N.autospectra(np.stack(pdf["frame"].to_numpy()), rate, window)[1]) if len(pdf) else []
            yield out

    return frames.mapInPandas(run, f"{_types(frames, [*keys, 'block_idx'])}, power array<double>").select(*keys, "block_idx", F.posexplode("power").alias("bin", "power"))


def autospectrum(signals: DataFrame, rate: float, nfft: int, overlap: float = 0.5, keys: Sequence[str] = KEYS, window: Callable[[int], np.ndarray] = np.ones) -> DataFrame:
    """bin, freq, power, rms, peak and psd averaged over complete blocks, and the window's normalised noise bandwidth."""
    w = window(nfft)
    noise = float(nfft * (w**2).sum() / w.sum() ** 2)
    mean = _spectra(frame_blocks(signals, nfft, overlap, keys), rate, keys, window).groupBy(*keys, "bin").agg(F.avg("power").alias("power"))
    mean = mean.filter(F.col("bin") < (nfft + 1) // 2)
    return mean.select(*keys, "bin", (F.col("bin") * rate / nfft).alias("freq"), "power", F.sqrt("power").alias("rms"), F.sqrt(2 * F.col("power")).alias("peak"), (F.col("power") / (rate / nfft * noise)).alias("psd"), F.lit(noise).alias("noise_bandwidth"))


def spectrogram(signals: DataFrame, rate: float, nfft: int, overlap: float = 0.5, keys: Sequence[str] = KEYS, window: Callable[[int], np.ndarray] = np.hanning) -> DataFrame:
    """Level (dB re 2e-5 Pa) of each block and frequency."""
    rows = _spectra(frame_blocks(signals, nfft, overlap, keys), rate, keys, window)
    return rows.select(*keys, "block_idx", (F.col("bin") * rate / nfft).alias("freq"), (10 * F.log10(F.col("power") / 4e-10)).alias("level_db"))


#: Natural log up to which powers of a decay are carried within a chunk, and beyond which what is left of one is nothing in double precision.
RANGE, NOTHING = 500.0, 46.0


def time_weight(signals: DataFrame, rate: float, tau: float, keys: Sequence[str] = KEYS, chunk: int = 65_536) -> DataFrame:
    """weighted: root of the exponential average of p**2, started from the first sample, whatever its number.

    Chunks of a recording are averaged from rest, as running sums of values scaled by powers of the decay; the
    carry into a chunk comes from the ends of the chunks before it, as many as leave a trace. A chunk is one
    window partition, so a long recording is never one task's work, and no Python runs.
    """
    steps = tau * rate
    k, chunk = math.exp(-1 / steps), max(1, min(chunk, int(RANGE * steps)))
    lookback = math.ceil(NOTHING * steps / chunk) + 1
    part = [*keys, "_chunk"]
    rows = signals.withColumn("_chunk", F.floor(F.col("sample_idx") / chunk))
    inside = W.Window.partitionBy(*part).orderBy("sample_idx")
    rows = rows.withColumn("_i", F.col("sample_idx") - F.min("sample_idx").over(W.Window.partitionBy(*part)))
    power = lambda n: F.exp(n.cast("double") * math.log(k))
    rows = rows.withColumn("_y", power(F.col("_i")) * F.sum((1 - k) * F.col("p") * F.col("p") * power(-F.col("_i"))).over(inside.rowsBetween(W.Window.unboundedPreceding, 0)))
    ends = rows.groupBy(*part).agg(F.max_by("_y", "_i").alias("end"), (F.max("_i") + 1).alias("n"), F.min_by(F.col("p") * F.col("p"), "_i").alias("first"))
    before = F.collect_list(F.struct("end", "n", "first")).over(W.Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(-lookback, -1))
    # of the first chunk that is looked back at, the first sample stands for what came before it
    carry = F.aggregate("_before", F.coalesce(F.get("_before", F.lit(0))["first"], F.col("first")), lambda y, c: c["end"] + y * power(c["n"]))
    carries = ends.withColumn("_before", before).select(*part, carry.alias("_carry"))
    out = rows.join(carries, part)
    return out.select(*signals.columns, F.sqrt(F.col("_y") + F.col("_carry") * power(F.col("_i") + 1)).alias("weighted"))


def in_chunks(df: DataFrame, keys: Sequence[str], order: str, chunk: int, before: int, after: int, run: Callable[[pd.DataFrame], pd.DataFrame], fields: str) -> DataFrame:
    """run over chunks of so many steps, each with the rows `before` and `after` it; only a chunk's own rows are kept.

    Rows beside a chunk's end are copied into the neighbour, so a task holds one chunk of a recording, however long.
    Chunks are dealt by key, sorted, and cut from the stream of a partition's rows, so that many short
    recordings cost one Python call a batch and not one each.
    """
    ship_package(df.sparkSession)
    at = F.col(order)
    rows = df.withColumn("_own", F.floor(at / chunk))
    first = F.greatest(F.floor((at - after) / chunk), F.least(F.col("_own"), F.lit(0)))
    rows = rows.withColumn("_chunk", F.explode(F.sequence(first, F.floor((at + before) / chunk))))

    group = [*keys, "_chunk"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame | None:
        own = (pdf["_own"] == pdf["_chunk"]).to_numpy()
        return run(pdf.reset_index(drop=True))[own] if own.any() else None

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            same = np.ones(len(pdf), bool)  # as the row before
            for c in group:
                x = pdf[c].to_numpy()
                last = held[-1][c].iloc[-1] if held else x[0]
                before = np.concatenate([np.array([last], dtype=x.dtype), x[:-1]])
                same &= (x == before) | (pd.isna(x) & pd.isna(before))
            cuts = [*np.flatnonzero(~same).tolist(), len(pdf)]
            held.append(pdf.iloc[: cuts[0]])
            done = []
            for start, end in zip(cuts, cuts[1:], strict=False):
                done.append(one(pd.concat(held) if len(held) > 1 else held[0]) if sum(map(len, held)) else None)
                held = [pdf.iloc[start:end]]
            done = [d for d in done if d is not None]
            if done:
                yield pd.concat(done)
        if sum(map(len, held)) and (last := one(pd.concat(held))) is not None:
            yield last

    dealt = rows.repartition(*group).sortWithinPartitions(*group, order)
    return dealt.mapInPandas(scan, f"{_types(rows, rows.columns)}, {fields}").drop("_own", "_chunk")


def _filtered(df: DataFrame, value: str, b: np.ndarray, a: np.ndarray, keys: Sequence[str], order: str, out: str, chunk: int, warm_up: int, steady: bool) -> DataFrame:
    """A recursive filter over chunks, each warmed up on the samples before it: the filter's memory of what came earlier has died out by then."""
    run = lambda pdf: pdf.assign(**{out: N.recursive_filter(b, a, pdf[value].to_numpy(float), steady)})
    return in_chunks(df, keys, order, chunk, warm_up, 0, run, f"{out} double")


def a_weight_time(signals: DataFrame, rate: float, keys: Sequence[str] = KEYS, chunk: int = 262_144) -> DataFrame:
    """weighted: the A-weighted signal. The slowest pole (20.6 Hz) dies out within half a second."""
    b, a = N.a_weight_coefficients(rate)
    return _filtered(signals, "p", b, a, keys, "sample_idx", "weighted", chunk, int(rate), True)


def noise_reduction_lowpass(curve: DataFrame, rate: float, keys: Sequence[str] = (*KEYS, "band"), chunk: int = 65_536) -> DataFrame:
    """smoothed: the curve through a third-order low pass."""
    b, a = N.third_order_lowpass(rate)
    return _filtered(curve, "value", b, a, keys, "t_idx", "smoothed", chunk, int(rate * 2) + 1, False)


def asymmetric_lowpass(spec: DataFrame, rate: float, rise: float = 0.0625, fall: float = 0.5, keys: Sequence[str] = KEYS, chunk: int = 8_192) -> DataFrame:
    """smoothed: first-order smoothing of each band, fast up and slow down; all bands of a recording at once.

    A step shrinks the difference of two states by the slower time constant at least, so a chunk that starts
    so many of these before its own steps has forgotten where it started.
    """
    rows = spec.groupBy(*keys, "t_idx").agg(F.array_sort(F.collect_list(F.struct("band", "value"))).alias("_v")).select(*keys, "t_idx", F.transform("_v", lambda x: x["band"]).alias("bands"), F.transform("_v", lambda x: x["value"]).alias("values"))
    run = lambda pdf: pdf.assign(smoothed=list(N.asymmetric_lowpass(np.stack(pdf["values"].to_numpy()), rate, rise, fall)))
    out = in_chunks(rows, keys, "t_idx", chunk, math.ceil(NOTHING * rate * max(rise, fall)), 0, run, "smoothed array<double>")
    return out.select(*keys, "t_idx", F.explode(F.arrays_zip("bands", "values", "smoothed")).alias("x")).select(*keys, "t_idx", F.col("x.bands").alias("band"), F.col("x.values").alias("value"), F.col("x.smoothed").alias("smoothed"))


def _in_ranges(rows: DataFrame, t: str, *then: str, ranges: int | None = None) -> DataFrame:
    """The rows in ranges of _key and time (_chunk numbers them), which cut long recordings; written, so that ranges don't change."""
    order = ["_key", t, *then]
    return _settled((rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)).withColumn("_chunk", F.spark_partition_id()))


def _around(points: DataFrame, t: str, item: Column, before: int, after: int) -> DataFrame:
    """Adds _a1, _a2, ... and _b1, ...: an item of the points before and after each one of its recording.

    Inside a range these come from a window; at its ends from the outermost points of all ranges, a few rows a range.
    """
    reach = max(before, after)
    inside = W.Window.partitionBy("_key", "_chunk").orderBy(t)
    steps = lambda w: [F.lag("_item", i).over(w).alias(f"_a{i}") for i in range(1, before + 1)] + [F.lead("_item", i).over(w).alias(f"_b{i}") for i in range(1, after + 1)]
    rows = points.withColumn("_item", item).select("*", F.row_number().over(inside).alias("_i"), F.row_number().over(W.Window.partitionBy("_key", "_chunk").orderBy(F.desc(t))).alias("_j"), *steps(inside))
    ends = _settled(rows.filter((F.col("_i") <= reach) | (F.col("_j") <= reach)).select("_key", t, "_item"))
    far = ends.select("_key", t, *steps(W.Window.partitionBy("_key").orderBy(t)))
    names = [f"_a{i}" for i in range(1, before + 1)] + [f"_b{i}" for i in range(1, after + 1)]
    far = far.select("_key", t, *[F.col(c).alias(f"{c}_far") for c in names])
    return rows.join(far, ["_key", t], "left").select(*points.columns, *[F.coalesce(c, f"{c}_far").alias(c) for c in names])


def _pchip_slope(t: str) -> Column:
    """Slope of the monotone cubic through a point: a weighted harmonic mean of the slopes beside it, 0 at a turn, and three points at an end."""
    gap = lambda a, b: b["t"] - a["t"]
    slope = lambda a, b: (b["v"] - a["v"]) / gap(a, b)
    here, a1, a2, b1, b2 = F.struct(F.col(t).alias("t"), F.col("_v").alias("v")), *map(F.col, ("_a1", "_a2", "_b1", "_b2"))

    def end(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        return F.when(s * d0 <= 0, 0.0).when((d0 * d1 <= 0) & (F.abs(s) > 3 * F.abs(d0)), 3 * d0).otherwise(s)

    h0, h1, d0, d1 = gap(a1, here), gap(here, b1), slope(a1, here), slope(here, b1)
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    inner = F.when(d0 * d1 <= 0, 0.0).otherwise((w0 + w1) / (w0 / d0 + w1 / d1))
    first = F.when(b2.isNull(), d1).otherwise(end(h1, gap(b1, b2), d1, slope(b1, b2)))
    last = F.when(a2.isNull(), d0).otherwise(end(h0, gap(a2, a1), d0, slope(a2, a1)))
    return F.when(a1.isNull() & b1.isNull(), 0.0).when(a1.isNull(), first).when(b1.isNull(), last).otherwise(inner)


def resample(curve: DataFrame, grid: DataFrame, keys: Sequence[str] = KEYS, t: str = "t", value: str = "value", cubic: bool = False, ranges: int | None = None) -> DataFrame:
    """Curve values at the grid's times (keys, t): between the samples around each, linear or on the monotone cubic; NULL outside of them.

    Recordings are cut in ranges of time, and each takes what it needs of the samples beyond its ends, so that no
    task holds a recording. Samples of one time are averaged, missing ones left out; a recording of one sample has
    its value at that time alone.
    """
    key = F.struct(*[F.col(k).alias(k) for k in keys]).alias("_key")
    points = curve.select(key, F.col(t), F.col(value).cast("double").alias("_v")).dropna(subset=[t, "_v"]).groupBy("_key", t).agg(F.avg("_v").alias("_v"))
    points = _in_ranges(points, t, ranges=ranges)
    if cubic:
        points = _around(points, t, F.struct(F.col(t).alias("t"), F.col("_v").alias("v")), 2, 2).select("_key", t, "_v", "_chunk", _pchip_slope(t).alias("_m"))
    else:
        points = points.withColumn("_m", F.lit(0.0))
    here = F.struct(F.col(t).cast("double").alias("t"), F.col("_v").alias("v"), F.col("_m").alias("m"))
    pieces = _around(points, t, here, 0, 1).select("_key", t, F.struct(here.alias("a"), F.col("_b1").alias("b")).alias("_piece"), F.lit(0).alias("_ask"))
    asked = grid.select(key, t, F.lit(1).alias("_ask"))
    rows = _in_ranges(pieces.unionByName(asked, allowMissingColumns=True), t, "_ask", ranges=ranges)
    left = rows.groupBy("_key", "_chunk").agg(F.max_by("_piece", F.when(F.col("_piece").isNotNull(), F.col(t))).alias("_left"))  # a row for each range of a recording
    carried = left.select("_key", "_chunk", F.last("_left", ignorenulls=True).over(W.Window.partitionBy("_key").orderBy("_chunk").rowsBetween(W.Window.unboundedPreceding, -1)).alias("_carried"))
    inside = F.last("_piece", ignorenulls=True).over(W.Window.partitionBy("_key", "_chunk").orderBy(t, "_ask").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow))
    found = rows.withColumn("_at", inside).filter("_ask = 1").join(carried, ["_key", "_chunk"], "left").withColumn("_at", F.coalesce("_at", "_carried"))
    a, b = F.col("_at.a"), F.col("_at.b")
    h = b["t"] - a["t"]
    s = (F.col(t) - a["t"]) / h
    linear = a["v"] + (b["v"] - a["v"]) * (F.col(t) - a["t"]) / h
    curved = a["v"] * (1 + 2 * s) * (1 - s) * (1 - s) + h * a["m"] * s * (1 - s) * (1 - s) + b["v"] * s * s * (3 - 2 * s) + h * b["m"] * s * s * (s - 1)
    return found.select(*[F.col(f"_key.{k}").alias(k) for k in keys], t, F.when(F.col(t) == a["t"], a["v"]).otherwise(curved if cubic else linear).alias(value))


def resample_linear(curve: DataFrame, grid: DataFrame, keys: Sequence[str] = KEYS, t: str = "t", value: str = "value") -> DataFrame:
    return resample(curve, grid, keys, t, value)


def align_curves(curves: Mapping[str, DataFrame], onto: str, keys: Sequence[str] = KEYS, t: str = "t", value: str = "value", cubic: bool = False) -> DataFrame:
    """keys, t and a column for each curve, at the times of the curve `onto` (the finest): the others are linear, or monotone cubics, between their samples, NULL outside of them."""
    grid = curves[onto].select(*keys, t)
    out = curves[onto].select(*keys, t, F.col(value).alias(onto))
    for name, curve in curves.items():
        if name != onto:
            out = out.join(resample(curve, grid, keys, t, value, cubic).withColumnRenamed(value, name), [*keys, t], "left")
    return out.select(*keys, t, *curves)


def _counted(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """keys, values and counts: the sorted distinct values of each group as arrays, counted before anything is moved.

    A rating scale has a handful whatever the number of ratings; of continuous measures it is as long as the group.
    """
    counts = df.select(*keys, value.cast("double").alias("_v")).filter(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    lists = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_v", "_n"))).alias("_l"))
    return lists.select(*keys, F.transform("_l", lambda x: x["_v"]).alias("values"), F.transform("_l", lambda x: x["_n"]).alias("counts"))


def _each(df: DataFrame, keys: Sequence[str], fn: Callable[[pd.Series], dict], fields: str) -> DataFrame:
    """The keys and fn's fields of every row."""
    ship_package(df.sparkSession)
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def run(batches):
        for pdf in batches:
            found = [fn(row) for _, row in pdf.iterrows()]
            yield pdf[list(keys)].assign(**{name: [f[name] for f in found] for name in names})

    return df.mapInPandas(run, f"{_types(df, keys)}, {fields}")


def grouped_statistic(df: DataFrame, keys: Sequence[str], value: str, fn: Callable[[np.ndarray, np.ndarray], float], out: str = "statistic") -> DataFrame:
    """fn(sorted distinct values, how often each occurs) of each group, without missing values."""
    one = lambda row: {out: float(fn(np.asarray(row["values"]), np.asarray(row["counts"])))}
    return _each(_counted(df, keys, F.col(value)), keys, one, f"{out} double")


#: Draws of one task.
DRAWS = 1_000


def bootstrap_ci(df: DataFrame, keys: Sequence[str], value: str, statistic: str = "median", n: int = 20_000, seed: int = 1) -> DataFrame:
    """Interval of the median (percentile) or mean (bias-corrected, accelerated) of each group.

    Values are counted first; a draw with replacement is then a multinomial draw of the counts, and tasks take
    DRAWS draws each, so the draws of one large group are spread. Seeds come from the group's key and the number
    of the task's draws, so results don't depend on order or partitions. Groups of equal values give themselves.
    """
    counted = _counted(df, keys, F.col(value)).withColumn("seed", F.xxhash64(F.lit(seed), *keys))
    tasks = counted.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(-(-n // DRAWS) - 1)))).repartition(*keys, "lot")

    def draw(row: pd.Series) -> dict:
        rng = np.random.default_rng([int(row["seed"]) & (2**63 - 1), int(row["lot"])])
        return {"draws": N.resampled(np.asarray(row["values"]), np.asarray(row["counts"]), statistic, min(DRAWS, n - DRAWS * int(row["lot"])), rng)}

    drawn = _each(tasks, [*keys, "lot"], draw, "draws array<double>").groupBy(*keys).agg(F.flatten(F.collect_list("draws")).alias("draws"))

    def interval(row: pd.Series) -> dict:
        low, high = N.interval(np.asarray(row["values"]), np.asarray(row["counts"]), np.sort(row["draws"]), statistic)
        return {"low": low, "high": high}

    return _each(counted.drop("seed").join(drawn, list(keys)), keys, interval, "low double, high double")


def harrell_davis_quartiles(df: DataFrame, key: str, y: str) -> DataFrame:
    """q1 and q3 of each group as beta-weighted means of its order statistics, for rating_outliers.

    A distinct value's weight follows from how many rows of its group lie below it, so the values of a group are
    weighed where they are, and only weighted sums are grouped.
    """
    ship_package(df.sparkSession)

    @F.pandas_udf("double")
    def weight(below: pd.Series, n: pd.Series, all_: pd.Series, q: pd.Series) -> pd.Series:
        a, b = (all_ + 1) * q, (all_ + 1) * (1 - q)
        return pd.Series(N.beta_cdfs((below + n) / all_, a, b) - N.beta_cdfs(below / all_, a, b), dtype=float)

    rows = order_counts(df, [key], y)
    share = lambda q: F.sum(weight("_before", "_n", "_all", F.lit(q)) * F.col("_v"))
    return rows.groupBy("_key").agg(share(0.25).alias("q1"), share(0.75).alias("q3")).select(F.col(f"_key.{key}").alias(key), "q1", "q3")


def permutation_test(df: DataFrame, keys: Sequence[str], a: str, b: str, n: int = 20_000, seed: int = 1) -> DataFrame:
    """p of the paired difference of each group by random sign flips, drawn for the counts of equal differences."""
    counted = _counted(df, keys, F.col(a) - F.col(b)).withColumn("seed", F.xxhash64(F.lit(seed), *keys))
    one = lambda row: {"p_value": N.permutation_p(np.asarray(row["values"]), np.asarray(row["counts"]), n, int(row["seed"]) & (2**63 - 1))}
    return _each(counted, keys, one, "p_value double")


def tost_p(summary: DataFrame) -> DataFrame:
    """Adds p, the larger one-sided p of t_low and t_high, and equivalent (p < 0.05), to paired differences."""
    ship_package(summary.sparkSession)

    @F.pandas_udf("double")
    def p(low: pd.Series, high: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([max(1 - N.t_cdf(a, k - 1), N.t_cdf(b, k - 1)) for a, b, k in zip(low, high, n, strict=True)], dtype=float)

    return summary.withColumn("p", p("t_low", "t_high", "n")).withColumn("equivalent", F.col("p") < 0.05)


def cluster_bootstrap_means(df: DataFrame, who: str, by: Sequence[str], y: str, replicates: int = 200, seed: int = 1) -> DataFrame:
    """Mean, deviation and quantiles of group means over replicates that draw participants with replacement.

    Each participant's multiplicity in a replicate is a Poisson(1) number of a hash of both, so the draw is
    a column, the rows of a participant stay together, and sums are weighted instead of rows repeated.
    """
    sums = df.groupBy(who, *by).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("replicate"), F.col(who)), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    steps, total, term = None, 0.0, math.exp(-1)
    for k in range(9):
        total += term
        steps = F.when(u <= total, F.lit(k)) if steps is None else steps.when(u <= total, F.lit(k))
        term /= k + 1
    rows = sums.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_m", steps.otherwise(F.lit(9)))
    means = rows.groupBy("replicate", *by).agg((F.sum(F.col("_m") * F.col("_s")) / F.sum(F.col("_m") * F.col("_n"))).alias("m"))
    return means.groupBy(*by).agg(F.count("m").alias("n"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
