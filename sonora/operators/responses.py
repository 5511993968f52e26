"""Listening-test responses: factors, change scores, summaries, reshaping and pairing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.acoustics import highly_annoyed, prob_ha
from .stats import exact_quantiles

#: Ranges of names, and stimuli that a participant is compared with at a time.
BUCKETS, LOT = 64, 10_000


def extract_factors(df: DataFrame, col: str, patterns: Mapping[str, str], baseline: str | None = None) -> DataFrame:
    """A factor column for each pattern of alternatives; NULL where none matches, "Baseline" where the name holds the baseline mark."""
    for name, pattern in patterns.items():
        found = F.regexp_extract(F.col(col), f"({pattern})", 1)
        value = F.when(found != "", found)
        df = df.withColumn(name, value if baseline is None else F.when(F.contains(F.col(col), F.lit(baseline)), "Baseline").otherwise(value))
    return df


def classify_by_substring(df: DataFrame, col: str, rules: Sequence[tuple[str, str]], out: str = "label") -> DataFrame:
    """Labels by substrings; of several rules that match, the last one counts."""
    labels = [F.when(F.contains(F.col(col), F.lit(part)), F.lit(label)) for part, label in reversed(rules)]
    return df.withColumn(out, F.coalesce(*labels))


def build_stimulus_key(df: DataFrame, ambient: str, video: str, start: str, count: str, is_base: Column, out: str = "stim_key") -> DataFrame:
    """Ambient, first part of the video name without its suffixes, start and count, joined by underscores; baselines are ambient_Baseline."""
    first = F.regexp_replace(F.element_at(F.split(F.col(video), "trajectory"), 1), "Fade|_reflection|_$", "")
    key = F.concat_ws("_", F.element_at(F.split(F.col(ambient), "_"), 1), first, F.col(start).cast("string"), F.col(count).cast("string"))
    return df.withColumn(out, F.when(is_base, F.concat(F.element_at(F.split(F.col(ambient), "_"), 1), F.lit("_Baseline"))).otherwise(key))


def strip_side(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.regexp_replace(F.col(col), "_(left|right)", ""))


def fill_defaults(df: DataFrame, defaults: Mapping[str, object], ints: Sequence[str] = (), first_word: Sequence[str] = (), replace: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """Fills missing values by column, casts to whole numbers, keeps the text before the first space, replaces whole values."""
    df = df.fillna(dict(defaults))
    columns = {c: F.col(c).cast("int") for c in ints} | {c: F.element_at(F.split(F.col(c), " "), 1) for c in first_word}
    for c, values in (replace or {}).items():
        out = None
        for old, new in values.items():
            out = F.when(F.col(c) == old, F.lit(new)) if out is None else out.when(F.col(c) == old, F.lit(new))
        columns[c] = out.otherwise(F.col(c))
    return df.withColumns(columns)


def _lookup(mapping: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def recode_categories(df: DataFrame, col: str, mapping: Mapping[str, str], default: str | None = None, keep: bool = False, out: str | None = None) -> DataFrame:
    """Values to groups; others become NULL, the default, or stay."""
    value = _lookup(mapping)[F.col(col)]
    if keep:
        value = F.coalesce(value, F.col(col))
    elif default is not None:
        value = F.when(F.col(col).isNotNull(), F.coalesce(value, F.lit(default)))
    return df.withColumn(out or col, value)


def ordinal_encode(df: DataFrame, col: str, levels: Sequence[str], out: str | None = None) -> DataFrame:
    """Rank (from 1) of an ordered category; NULL for other values."""
    return df.withColumn(out or col, _lookup({v: i for i, v in enumerate(levels, 1)})[F.col(col)])


def filter_participants(df: DataFrame, omit: DataFrame, key: str = "participant") -> DataFrame:
    return df.join(omit.select(key).distinct(), key, "left_anti")


def split_test_aux(df: DataFrame, is_aux: Column) -> tuple[DataFrame, DataFrame]:
    """Test and auxiliary rows, each without the columns that hold nothing there (one pass of counts decides; NULL predicates are test rows)."""
    aux = F.coalesce(is_aux, F.lit(False))
    counts = df.agg(*[F.count(F.when(w, F.col(c))).alias(f"{t}_{c}") for t, w in (("t", ~aux), ("a", aux)) for c in df.columns]).first()
    return tuple(df.filter(w).select(*[c for c in df.columns if counts[f"{t}_{c}"]]) for t, w in (("t", ~aux), ("a", aux)))


def change_from_baseline(df: DataFrame, who: Sequence[str], is_base: Column, measures: Sequence[str]) -> DataFrame:
    """d_<measure>: value less the group's baseline; 0 on baselines, NULL where the group has none."""
    w = W.Window.partitionBy(*who)
    out = df
    for m in measures:
        base = F.max(F.when(is_base, F.col(m))).over(w)
        out = out.withColumn(f"d_{m}", F.when(is_base, F.lit(0.0)).otherwise(F.col(m) - base))
    return out


def change_to_highly_annoyed(df: DataFrame, who: Sequence[str], is_base: Column, rating: str = "rating") -> DataFrame:
    """Adds ha, p_ha and their changes: d_ha only where the baseline isn't highly annoyed, d_p_ha only where its probability is below 0.5 (0 on such baselines)."""
    w = W.Window.partitionBy(*who)
    df = df.withColumn("ha", highly_annoyed(F.col(rating))).withColumn("p_ha", prob_ha(F.col(rating)))
    base_ha, base_p = F.max(F.when(is_base, F.col("ha"))).over(w), F.max(F.when(is_base, F.col("p_ha"))).over(w)
    return df.withColumn("d_ha", F.when(base_ha == 0, F.col("ha"))).withColumn("d_p_ha", F.when(base_p < 0.5, F.when(is_base, 0.0).otherwise(F.col("p_ha"))))


def stimulus_summary(df: DataFrame, key: str, measures: Sequence[str], binary: Sequence[str] = ()) -> DataFrame:
    """One row for each stimulus and measure: n, median, mean; total and proportion for binary measures. Missing values don't count."""
    long = df.select(key, *[F.col(m).cast("double").alias(m) for m in [*measures, *binary]]).unpivot([key], [*measures, *binary], "measure", "value")
    two = F.col("measure").isin(list(binary)) if binary else F.lit(False)
    out = long.groupBy(key, "measure").agg(F.count("value").alias("n"), F.percentile("value", F.lit(0.5)).alias("median"), F.avg("value").alias("mean"), F.sum("value").alias("total"))
    return out.select(key, "measure", "n", F.when(~two, F.col("median")).alias("median"), F.col("mean"), F.when(two, F.col("total")).alias("total"), F.when(two, F.col("total") / F.col("n")).alias("proportion"))


def response_shares(df: DataFrame, by: str, y: str, values: Sequence) -> DataFrame:
    """Share of each response value in a group, one column each."""
    total = F.count(F.col(y))
    return df.groupBy(by).agg(*[(F.sum((F.col(y) == v).cast("int")) / total).alias(f"share_{v:g}") for v in values])


def crosstab_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of all pairs of two categories' levels, those that don't occur too. The levels are few; their pairs are the result."""
    counts = df.groupBy(a, b).agg(F.count("*").alias("n"))
    levels = counts.agg(F.collect_set(a).alias("_a"), F.collect_set(b).alias("_b"))
    pairs = levels.select(F.explode("_a").alias(a), "_b").select(a, F.explode("_b").alias(b))
    return pairs.join(counts, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def group_location(df: DataFrame, by: Sequence[str], y: str, base: Column) -> DataFrame:
    """Median and mean by group, with the median of the baseline rows that share the first group column."""
    rated = df.filter(~base)
    medians = exact_quantiles(rated, by, y, [0.5], "_q").select(F.struct(*by).alias("_by"), F.get("_q", F.lit(0)).alias("median"))
    stats = rated.groupBy(*by).agg(F.avg(y).alias("mean"), F.count(y).alias("n"))
    stats = stats.join(medians, F.struct(*by) == F.col("_by"), "left").select(*by, "median", "mean", "n")
    bases = exact_quantiles(df.filter(base), by[:1], y, [0.5], "_q").select(by[0], F.get("_q", F.lit(0)).alias("base_median"))
    return stats.join(bases, by[0], "left")


def rating_outliers(df: DataFrame, who: str = "participant", key: str = "stimulus", y: str = "rating", k: float = 1.5, quartiles: DataFrame | None = None) -> DataFrame:
    """Ratings outside the stimulus's Tukey fences, counted by participant and as a share of their ratings. quartiles (key, q1, q3) may come from another estimator."""
    if quartiles is None:
        quartiles = exact_quantiles(df, [key], y, [0.25, 0.75], "_q").select(key, F.get("_q", F.lit(0)).alias("q1"), F.get("_q", F.lit(1)).alias("q3"))
    far = (F.col(y) < F.col("q1") - k * (F.col("q3") - F.col("q1"))) | (F.col(y) > F.col("q3") + k * (F.col("q3") - F.col("q1")))
    return df.join(quartiles, key).groupBy(who).agg(F.sum(far.cast("int")).alias("n_outliers"), F.count(y).alias("n_ratings")).withColumn("share", F.col("n_outliers") / F.col("n_ratings"))


def notice_anomalies(df: DataFrame, who: str, loudness: str, noticed: str, low: float = 0.3, high: float = 13.0) -> DataFrame:
    """False alarms (noticed below low) and misses (not noticed above high) of each participant, and their percentage."""
    alarm, miss = (F.col(loudness) < low) & (F.col(noticed) == 1), (F.col(loudness) > high) & (F.col(noticed) == 0)
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = df.groupBy(who).agg(count(alarm).alias("false_alarms"), count(miss).alias("misses"), F.count("*").alias("n"))
    return out.withColumn("percent", 100 * (F.col("false_alarms") + F.col("misses")) / F.col("n"))


def merge_measures(tables: Sequence[DataFrame], key: str, how: str = "inner") -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, key, how)
    return out


def join_responses_stimuli_people(responses: DataFrame, stimuli: DataFrame, people: DataFrame, stim: str = "stimulus", who: str = "participant") -> DataFrame:
    """Responses with their stimulus (either may be missing) and their participant."""
    return responses.join(stimuli, stim, "full_outer").join(people, who, "left")


def natural_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on all columns that both have."""
    return a.join(b, [c for c in a.columns if c in b.columns])


def attach_components(combined: DataFrame, source_only: DataFrame, ambient_only: DataFrame, source_key: str, ambient_key: str, metrics: Sequence[str], is_base: Column) -> DataFrame:
    """Source-only and ambient-only metrics beside each combined stimulus (source_<m>, ambient_<m>); baselines have 0 for the source."""
    s = source_only.select(source_key, *[F.col(m).alias(f"source_{m}") for m in metrics])
    a = ambient_only.select(ambient_key, *[F.col(m).alias(f"ambient_{m}") for m in metrics])
    out = combined.join(s, source_key, "left").join(a, ambient_key, "left")
    return out.withColumns({f"source_{m}": F.when(is_base, F.coalesce(F.col(f"source_{m}"), F.lit(0.0))).otherwise(F.col(f"source_{m}")) for m in metrics})


def level_differences(df: DataFrame, source: Sequence[str], ambient: Sequence[str]) -> DataFrame:
    """<source>_less_<ambient> for all pairs of level columns."""
    return df.withColumns({f"{s}_less_{a}": F.col(s) - F.col(a) for s in source for a in ambient})


def detection_discounted_level(df: DataFrame, levels: Mapping[str, tuple[str, str]]) -> DataFrame:
    """New level columns: name -> (level, discount), the level less what masking takes from its detection."""
    return df.withColumns({name: F.col(level) - F.col(discount) for name, (level, discount) in levels.items()})


def combine_pairs(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Left and right rows of a stimulus as their mean; rows without a side stay as they are; new ids in name order."""
    rows = df.withColumn("_key", F.regexp_replace(F.col(key), "_(left|right)", ""))
    out = rows.groupBy("_key").agg(*[F.avg(v).alias(v) for v in values]).withColumnRenamed("_key", key)
    return assign_ids(out, key)


def assign_ids(stimuli: DataFrame, key: str, out: str = "stim_id", start: int = 1) -> DataFrame:
    """Ids from start on in name order, equal names in any order.

    Names are dealt to ranges between about BUCKETS names drawn by hash; the counts of the ranges give each its first id.
    """
    share = 20 * BUCKETS / max(1, stimuli.count())
    drawn = stimuli.select(key).filter(F.lit(share >= 1) | (F.pmod(F.xxhash64(F.lit(3), key), F.lit(1 << 53)) < F.lit(int(min(1.0, share) * (1 << 53))))).distinct()
    names = sorted(r[0] for r in drawn.collect() if r[0] is not None)
    cuts = names[:: max(1, len(names) // BUCKETS)][1:]
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    rows = stimuli.withColumn("_b", F.when(F.col(key).isNull(), -1).otherwise(bucket))
    before = W.Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(W.Window.unboundedPreceding, -1)
    first = rows.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.Window.partitionBy("_b").orderBy(key))
    return rows.withColumn("_i", inside).join(F.broadcast(first), "_b").withColumn(out, (F.col("_i") + F.col("_first") + (start - 1)).cast("int")).drop("_b", "_i", "_first")


def missing_pairs(df: DataFrame, who: str = "participant", key: str = "stimulus") -> DataFrame:
    """Stimuli that others rated and a participant did not. Stimuli are dealt by hash to lots of about LOT, and a participant is compared with a lot at a time."""
    stimuli = df.select(key).filter(F.col(key).isNotNull()).distinct()
    lots = max(1, -(-stimuli.count() // LOT))
    if lots == 1:
        every = stimuli.agg(F.collect_list(key).alias("_all"))
        return df.groupBy(who).agg(F.collect_set(key).alias("_own")).join(F.broadcast(every)).select(who, F.explode(F.array_except("_all", "_own")).alias(key))
    lot = F.pmod(F.xxhash64(key), F.lit(lots)).alias("_lot")
    own = df.select(who, key, lot).groupBy(who, "_lot").agg(F.collect_set(key).alias("_own"))
    asked = df.select(who).distinct().withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))))
    every = stimuli.select(key, lot).groupBy("_lot").agg(F.collect_list(key).alias("_all"))
    both = asked.join(own, [who, "_lot"], "left").join(every, "_lot")
    return both.select(who, F.explode(F.array_except("_all", F.coalesce("_own", F.array().cast(dict(every.dtypes)["_all"])))).alias(key))


def fill_missing_pairs(df: DataFrame, who: str = "participant", key: str = "stimulus") -> DataFrame:
    return df.unionByName(missing_pairs(df, who, key), allowMissingColumns=True)


def stimulus_change(df: DataFrame, key: str, cols: Sequence[str], is_ambient: Column) -> DataFrame:
    """d_<col>: less the ambient-only row's value with the same first part of the key."""
    part = F.substring_index(F.col(key), "_", 1)
    ambient = df.filter(is_ambient).select(part.alias("_part"), *[F.col(c).alias(f"_{c}") for c in cols])
    return df.filter(~is_ambient).withColumn("_part", part).join(ambient, "_part", "left").select(*df.columns, *[(F.col(c) - F.col(f"_{c}")).alias(f"d_{c}") for c in cols])


def snap_to_grid(df: DataFrame, col: str, grid: Sequence[float], tol: float) -> DataFrame:
    """Values within tol of the largest grid value not above x + tol become it; others stay."""
    x, g = F.col(col), F.array(*[F.lit(float(v)) for v in sorted(grid)])
    best = F.array_max(F.filter(g, lambda v: v - tol * 1.000001 <= x))
    return df.withColumn(col, F.when(x - best <= tol * 1.000001, best).otherwise(x))


def to_wide(df: DataFrame, id_col: str, col: str, value: str, values: Sequence) -> DataFrame:
    """One column for each value of col; a pair that occurs twice is an error, found in the same pass."""
    once = F.when(F.count(value) > 1, F.raise_error(F.lit("duplicate entries for a pair"))).otherwise(F.first(value, ignorenulls=True))
    return df.groupBy(id_col).pivot(col, list(values)).agg(once)


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(cols), name, value)


def momentary_to_long(df: DataFrame, ids: Sequence[str], series: str, step: float = 0.1) -> DataFrame:
    """step_idx, t and rating of an array of momentary ratings."""
    return df.select(*ids, F.posexplode(series).alias("step_idx", "rating")).withColumn("t", F.col("step_idx") * step)


def rank_importance(df: DataFrame, k: int, name: str = "variable", value: str = "importance") -> DataFrame:
    """The k variables of largest summed importance, with their order number."""
    sums = df.groupBy(name).agg(F.sum(value).alias(value))
    top = sums.orderBy(F.desc(value), name).limit(k)
    return top.withColumn("rank", F.row_number().over(W.Window.partitionBy(F.lit(0)).orderBy(F.desc(value), name)))


def union_parts(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def transpose_ratings(a: DataFrame, b: DataFrame, who: str, stimuli_a: Sequence[str], stimuli_b: Sequence[str]) -> DataFrame:
    """stimulus, rater, rating of two wide tables, for raters that both hold."""
    shared = a.select(who).join(b.select(who), who, "left_semi")
    part = lambda df, cols: to_long(df.join(shared, who, "left_semi"), [who], cols, "stimulus", "rating")
    return part(a, stimuli_a).unionByName(part(b, stimuli_b))


def first_per_participant(df: DataFrame, who: str, cols: Sequence[str]) -> DataFrame:
    """One of each participant's rows: the first by the columns in turn."""
    return df.groupBy(who).agg(F.min(F.struct(*cols)).alias("_first")).select(who, "_first.*")


def impute_median(df: DataFrame, col: str) -> DataFrame:
    """Missing values become the median of the others; adds a mark."""
    median = exact_quantiles(df, [], col, [0.5], "_q").select(F.get("_q", F.lit(0)).alias("_median"))
    return df.join(F.broadcast(median)).withColumn(f"{col}_missing", F.col(col).isNull()).withColumn(col, F.coalesce(F.col(col).cast("double"), F.col("_median"))).drop("_median")


def participant_folds(df: DataFrame, who: str, k: int, seed: int = 1) -> DataFrame:
    """Adds fold: balanced, by a seeded hash order of participants, all rows of one in one fold.

    Participants are dealt in hash buckets, and the buckets' counts give each its first number, so no task sorts all.
    """
    ids = df.select(who).distinct().withColumn("_h", F.xxhash64(F.lit(seed), F.col(who))).withColumn("_b", F.pmod("_h", F.lit(64)))
    counts = ids.groupBy("_b").agg(F.count("*").alias("_n"))
    first = counts.withColumn("_first", F.coalesce(F.sum("_n").over(W.Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = ids.withColumn("_i", F.row_number().over(W.Window.partitionBy("_b").orderBy("_h", who)) - 1).join(F.broadcast(first), "_b")
    return df.join(numbered.select(who, ((F.col("_i") + F.col("_first")) % k).cast("int").alias("fold")), who)


def trial_numbering(a: DataFrame, b: DataFrame, who: str = "participant", trial: str = "trial", overrides: Mapping[int, int] | None = None) -> DataFrame:
    """Part-b trials go on from the participant's last part-a trial, or from an override."""
    last = a.groupBy(who).agg(F.max(trial).alias("_last"))
    if overrides:
        last = last.withColumn("_last", F.coalesce(_lookup(overrides)[F.col(who)].cast("long"), F.col("_last")))
    tail = b.join(last, who, "left").withColumn("overall", F.col(trial) + F.coalesce("_last", F.lit(0))).drop("_last")
    return a.withColumn("overall", F.col(trial)).unionByName(tail)


def bin_levels(df: DataFrame, col: str, step: float, out: str) -> DataFrame:
    """Nearest multiple of step; ties go to the even one."""
    return df.withColumn(out, F.rint(F.col(col) / step) * step)


def event_rate(df: DataFrame, events: str, seconds: str) -> DataFrame:
    return df.withColumn("events_per_minute", F.col(events) / (F.col(seconds) / 60))


def beta_scale(df: DataFrame, col: str, lo: float, hi: float, squeeze: str | None = None, direction: str = "forward", out: str | None = None, epsilon: float = 1e-6) -> DataFrame:
    """Rescales lo..hi to 0..1, or back from there. "smithson" squeezes by the row count N, "basic" by epsilon at both ends.

    Backwards, the squeeze is undone after rescaling, so it is the exact inverse on a 0..1 scale only.
    """
    if direction not in ("forward", "reverse"):
        raise ValueError(direction)
    forward, out = direction == "forward", out or f"{col}_beta"
    x = (F.col(col) - lo) / (hi - lo) if forward else F.col(col) * (hi - lo) + lo
    if squeeze == "smithson":
        n = F.col("_n")
        rows = df.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))))
        return rows.withColumn(out, (x * (n - 1) + 0.5) / n if forward else (x * n - 0.5) / (n - 1)).drop("_n")
    if squeeze == "basic":
        x = x * (1 - 2 * epsilon) + epsilon if forward else (x - epsilon) / (1 - 2 * epsilon)
    return df.withColumn(out, x)


def standardise(df: DataFrame, cols: Sequence[str], scale: bool | Sequence[bool] = True, by: Sequence[str] = ()) -> DataFrame:
    """<col>_scl: centred, and divided by the standard deviation if scale (one flag, or one for each column); over all rows or by group. Absent columns are skipped."""
    flags = dict(zip(cols, [scale] * len(cols) if isinstance(scale, bool) else scale, strict=True))
    cols = [c for c in cols if c in df.columns]
    stats = df.groupBy(*by).agg(*[x for c in cols for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])
    joined = df.join(stats, list(by)) if by else df.join(F.broadcast(stats))
    return joined.select(*df.columns, *[((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") if flags[c] else F.lit(1.0))).alias(f"{c}_scl") for c in cols])
