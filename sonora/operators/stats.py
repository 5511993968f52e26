"""Statistics of ratings, predictions and draws, as aggregates, windows and joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..runtime import shared_folder

#: Distinct values that a range holds, about; quantiles that the first look at the values takes; ranges of few values.
PER_RANGE, FINE, FEW = 1_000_000, 1024, 64


def _cuts(counts: DataFrame, col: str) -> list[float]:
    """Ends of ranges of about equally many distinct values: one for each PER_RANGE of them, and up to FEW where there are fewer.

    One look takes the number of values and FINE quantiles; only for more ranges than these there is a second one.
    """
    value = F.col(col).cast("double")
    n, found = counts.agg(F.count(col), F.percentile_approx(value, [i / FINE for i in range(1, FINE)], 10 * FINE)).first()
    ranges = max(min(FEW, (n or 0) // 1000), (n or 0) // PER_RANGE + 1)
    if ranges > FINE:
        found = counts.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
        return sorted(set(found))
    return sorted({found[i * FINE // ranges - 1] for i in range(1, ranges)}) if found else []


def running_counts(counts: DataFrame, col: str, n: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds the sum of n over all smaller values of col, within each group of `by`. counts: one row for each value (and group).

    Values are dealt to ranges between approximate quantiles, the more the more values there are; the sums of
    the ranges before, and a window inside each range, make the exact sums, so no task sorts all values.
    """
    from pyspark.ml.feature import Bucketizer

    cuts = [c for c in _cuts(counts, col) if abs(c) < float("inf")]
    groups = [F.col(c) for c in by] or [F.lit(0)]
    if not cuts:
        return counts.withColumn(out, F.coalesce(F.sum(n).over(W.Window.partitionBy(*groups).orderBy(col).rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)))
    dealt = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_value", outputCol="_range", handleInvalid="keep").transform(counts.withColumn("_value", F.col(col).cast("double"))).drop("_value")
    before = W.Window.partitionBy(*groups).orderBy("_range").rowsBetween(W.Window.unboundedPreceding, -1)
    first = dealt.groupBy(*by, "_range").agg(F.sum(n).alias("_sum")).withColumn("_first", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")  # a row for each range of a group
    inside = W.Window.partitionBy(*by, "_range").orderBy(col).rowsBetween(W.Window.unboundedPreceding, -1)
    rows = dealt.withColumn("_below", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(first if by else F.broadcast(first), [*by, "_range"])
    return rows.withColumn(out, F.col("_below") + F.col("_first")).drop("_range", "_below", "_first")


def order_counts(df: DataFrame, keys: Sequence[str], value: str | Column) -> DataFrame:
    """_key (struct of the keys), _v (the distinct values of each group), _n (how often), _before (rows of smaller values) and _all (rows of the group); NULL counts nowhere."""
    own = value if isinstance(value, Column) else F.col(value)
    counts = df.select(F.struct(*[F.col(k).alias(k) for k in keys] or [F.lit(0).alias("_one")]).alias("_key"), own.cast("double").alias("_v")).filter(F.col("_v").isNotNull()).groupBy("_key", "_v").agg(F.count("*").alias("_n"))
    counts = _settled(counts)
    total = counts.groupBy("_key").agg(F.sum("_n").alias("_all"))
    return running_counts(counts, "_v", "_n", "_before", ["_key"]).join(total, "_key")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str | Column, shares: Sequence[float], out: str = "quantiles") -> DataFrame:
    """keys and out: the quantiles of each group at the shares, linear between neighbouring values, as an array.

    Values are counted, and the running counts of their ranges find each rank, so that no buffer holds a group's
    values, however many and however different these are. A group without a value has no row; without keys there
    is one row always, of NULLs if there is no value.
    """
    rows = order_counts(df, keys, value)
    here = lambda rank: F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")), F.col("_v")))
    place = lambda q: F.lit(float(q)) * (F.col("_all") - 1)
    found = [(here(F.floor(place(q))), here(F.ceil(place(q))), F.max(place(q) - F.floor(place(q)))) for q in shares]
    columns = [c.alias(f"_{k}{i}") for i, parts in enumerate(found) for k, c in zip("lhf", parts, strict=True)]
    groups = rows.groupBy("_key").agg(*columns) if keys else rows.agg(*columns)
    between = F.array(*[F.when(F.col(f"_f{i}") == 0, F.col(f"_l{i}")).otherwise((1 - F.col(f"_f{i}")) * F.col(f"_l{i}") + F.col(f"_f{i}") * F.col(f"_h{i}")) for i in range(len(shares))])
    return groups.select(*[F.col(f"_key.{k}").alias(k) for k in keys], between.alias(out))


def mean_ranks(df: DataFrame, col: str, out: str) -> DataFrame:
    """Adds average ranks (from 1). Distinct values are counted first, and only the counts are summed in order; a NULL has no rank."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("_v")).agg(F.count("*").alias("_n"))
    ranks = running_counts(counts, "_v", "_n", "_before").select("_v", (F.col("_before") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, F.col(col) == F.col("_v"), "left").drop("_v")


def _settled(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder; shared_folder sets one where none is named."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()


def correlation_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """a, b, r, low, high: every pair of columns over rows without NULL, with the Fisher interval. Kendall is tau-b from counts of value pairs."""
    rows = _complete(df, cols)
    if method == "kendall":
        out = None
        for a, b in combinations(cols, 2):
            one = kendall(rows, a, b)
            out = one if out is None else out.unionByName(one)
        return _with_interval(out)
    if method == "spearman":
        for c in cols:
            rows = mean_ranks(rows, c, f"_r_{c}")
        rows = rows.select(*[F.col(f"_r_{c}").alias(c) for c in cols])
    wide = rows.agg(F.count("*").alias("n"), *[F.corr(a, b).alias(f"{a}|{b}") for a, b in combinations(cols, 2)])
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in combinations(cols, 2)])
    return _with_interval(wide.select("n", F.explode(pairs).alias("p")).select("p.a", "p.b", "p.r", "n"))


def _with_interval(df: DataFrame) -> DataFrame:
    z, half = F.atanh("r"), 1.959963984540054 / F.sqrt(F.col("n") - 3)
    return df.select("a", "b", "r", "n", F.tanh(z - half).alias("low"), F.tanh(z + half).alias("high"))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """tau-b by counts of value pairs, for any number of them.

    The gapless ranks of the column of fewer values are halved level by level: two ranks part at exactly one level, where
    one stands in the lower and one in the upper half of a group. A level's concordant less discordant pairs are then sums
    over the other column's values in order, so n pairs cost n times the logarithm of the number of ranks.
    """
    t = _settled(df.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").cast("double").alias("k")))
    size = t.agg(F.count_distinct("x").alias("x"), F.count_distinct("y").alias("y")).first()
    u, v = ("x", "y") if size["x"] <= size["y"] else ("y", "x")
    levels = max(1, (size[u] - 1).bit_length())
    ranks = running_counts(t.select(F.col(u).alias("_u")).distinct().withColumn("_one", F.lit(1)), "_u", "_one", "_rank").select("_u", F.col("_rank").cast("long").alias("_rank"))
    cells = t.join(ranks, F.col(u) == F.col("_u")).select("_rank", F.col(v).alias("v"), "k", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("_level"))
    cells = cells.select("_level", F.expr("shiftright(_rank, _level + 1)").alias("_group"), F.expr("(shiftright(_rank, _level) & 1) = 1").alias("_upper"), "v", "k")
    halves = _settled(cells.groupBy("_level", "_group", "v").agg(F.sum(F.when(F.col("_upper"), 0.0).otherwise(F.col("k"))).alias("lower"), F.sum(F.when(F.col("_upper"), F.col("k")).otherwise(0.0)).alias("upper")))
    below = running_counts(halves, "v", "lower", "below", ["_level", "_group"]).agg(F.sum(F.col("upper") * (2 * F.col("below") + F.col("lower"))).alias("_more"))
    groups = halves.groupBy("_level", "_group").agg(F.sum("lower").alias("l"), F.sum("upper").alias("u")).agg(F.sum(F.col("l") * F.col("u")).alias("_all"))
    sums = below.join(F.broadcast(groups)).select((F.col("_more") - F.col("_all")).alias("s"))
    half = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    tx = t.groupBy("x").agg(F.sum("k").alias("c")).agg(half("c").alias("tx"))
    ty = t.groupBy("y").agg(F.sum("k").alias("c")).agg(half("c").alias("ty"))
    n = t.agg(F.sum("k").alias("n"))
    one = sums.join(F.broadcast(tx)).join(F.broadcast(ty)).join(F.broadcast(n))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return one.select(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col("s") / F.sqrt((pairs - F.col("tx")) * (pairs - F.col("ty")))).alias("r"), F.col("n").cast("long").alias("n"))


def icc_consistency(df: DataFrame, subject: str, rater: str, y: str) -> DataFrame:
    """Two-way consistency of the mean of k raters: (MS subjects - MS error) / MS subjects, for complete tables."""
    grand = df.agg(F.avg(y).alias("g"), F.sum(F.col(y) * F.col(y)).alias("q"), F.count(y).alias("cells"))
    s = df.groupBy(subject).agg(F.avg(y).alias("m"))
    r = df.groupBy(rater).agg(F.avg(y).alias("m"))
    ss = s.agg(F.count("*").alias("n"), F.sum(F.col("m") * F.col("m")).alias("ss"))
    rr = r.agg(F.count("*").alias("k"), F.sum(F.col("m") * F.col("m")).alias("rr"))
    t = grand.join(F.broadcast(ss)).join(F.broadcast(rr))
    total = F.col("q") - F.col("cells") * F.col("g") * F.col("g")
    subjects = F.col("k") * F.col("ss") - F.col("cells") * F.col("g") * F.col("g")
    raters = F.col("n") * F.col("rr") - F.col("cells") * F.col("g") * F.col("g")
    msr, mse = subjects / (F.col("n") - 1), (total - subjects - raters) / ((F.col("n") - 1) * (F.col("k") - 1))
    return t.select("n", "k", ((msr - mse) / msr).alias("icc"))


def paired_difference(df: DataFrame, key: str, a: str, b: str, bound: float) -> DataFrame:
    """Mean difference of paired columns with its deviation, correlation, Cohen's d and the two one-sided t statistics against +-bound."""
    rows = df.select(key, (F.col(a) - F.col(b)).alias("d"), F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    out = rows.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.corr("a", "b").alias("r"))
    se = F.col("sd") / F.sqrt("n")
    return out.select("n", "mean", "sd", "r", (F.col("mean") / F.col("sd")).alias("cohen_d"), ((F.col("mean") + bound) / se).alias("t_low"), ((F.col("mean") - bound) / se).alias("t_high"))


def cv_metrics(df: DataFrame, y: str, mu: str, fold: str) -> DataFrame:
    """mse, rmse, mae, r2 and gelman_r2 by fold, overall (fold -1), and the folds' standard errors of rmse, mae and r2."""
    e = F.col(y) - F.col(mu)
    agg = [F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("vy"), F.var_samp(mu).alias("vm"), F.var_samp(e).alias("ve")]
    finish = lambda d: d.select("fold", "n", "mse", F.sqrt("mse").alias("rmse"), "mae", (1 - F.col("mse") / F.col("vy")).alias("r2"), (F.col("vm") / (F.col("vm") + F.col("ve"))).alias("gelman_r2"))
    folds = finish(df.groupBy(F.col(fold).cast("int").alias("fold")).agg(*agg))
    whole = finish(df.agg(*agg).withColumn("fold", F.lit(-1)))
    se = folds.agg(*[(F.stddev_samp(c) / F.sqrt(F.count("*"))).alias(f"{c}_se") for c in ("rmse", "mae", "r2")])
    return folds.unionByName(whole).join(F.broadcast(se))


def cv_metrics_by_stimulus(df: DataFrame, y: str, mu: str, stimulus: str, back: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """rmse, mae and r2 of stimulus means, after a back-transformation of each value."""
    rows = df.groupBy(stimulus).agg(F.avg(back(F.col(y))).alias("y"), F.avg(back(F.col(mu))).alias("mu"))
    e = F.col("y") - F.col("mu")
    return rows.agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.avg(e * e) / F.var_pop("y")).alias("r2"))


def binary_metrics(df: DataFrame, y: str, mu: str, clip: float = 1e-6) -> DataFrame:
    """auc (average ranks), tjur (difference of means) and log loss of 0/1 outcomes."""
    rows = mean_ranks(df.select(F.col(y).cast("double").alias("y"), F.col(mu).alias("mu")), "mu", "rank")
    p = F.least(F.greatest(F.col("mu"), F.lit(clip)), F.lit(1 - clip))
    one = F.sum("y")
    return rows.agg(((F.sum(F.when(F.col("y") == 1, F.col("rank"))) - one * (one + 1) / 2) / (one * (F.count("*") - one))).alias("auc"), (F.avg(F.when(F.col("y") == 1, F.col("mu"))) - F.avg(F.when(F.col("y") == 0, F.col("mu")))).alias("tjur"), (-F.avg(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))).alias("log_loss"))


def conformal_margin(df: DataFrame, y: str, mu: str, level: float) -> DataFrame:
    """The ceil(level (n + 1))-th smallest absolute residual (at most the n-th) and its coverage.

    Distinct residuals are counted, and the running sums of the counts find the rank, so rows are never sorted as a whole.
    """
    counts = df.select(F.abs(F.col(y) - F.col(mu)).alias("r")).groupBy("r").agg(F.count("*").alias("k"))
    n = counts.agg(F.sum("k").alias("n"))
    running = running_counts(counts, "r", "k", "before").withColumn("upto", F.col("before") + F.col("k"))
    rows = running.join(F.broadcast(n))
    want = F.least(F.ceil(level * (F.col("n") + 1)), F.col("n"))
    return rows.filter(F.col("upto") >= want).agg(F.min(F.struct("r", "upto", "n")).alias("m")).select(F.col("m.r").alias("margin"), (F.col("m.upto") / F.col("m.n")).alias("coverage"))


def fit_scores(df: DataFrame, y: str, mu: str, low: str, high: str) -> DataFrame:
    """r2, rmse counting only what a prediction misses the interval by, and percent of predictions inside it."""
    e, out = F.col(y) - F.col(mu), F.greatest(F.col(low) - F.col(mu), F.col(mu) - F.col(high), F.lit(0.0))
    return df.agg((1 - F.avg(e * e) / F.var_pop(y)).alias("r2"), F.sqrt(F.avg(out * out)).alias("rmse_outside"), (100 * F.avg((out == 0).cast("int"))).alias("percent_inside"))


def percent_correct(df: DataFrame, y: str, mu: str) -> DataFrame:
    """Expected share of correct predictions of 0/1 outcomes."""
    return df.agg(F.avg(F.when(F.col(y) == 1, F.col(mu)).otherwise(1 - F.col(mu))).alias("percent_correct"))


def entropy_reduction(df: DataFrame, y: str, mu: str, clip: float = 1e-15) -> DataFrame:
    """Share by which predictions mu of 0/1 outcomes y lower the entropy of their mean."""
    inside = lambda p: F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    entropy = lambda p: p * F.log(p) + (1 - p) * F.log(1 - p)
    sums = df.agg(F.sum(entropy(inside(F.col(mu)))).alias("s"), F.count(y).alias("n"), F.avg(y).alias("a"))
    return sums.select((1 - F.col("s") / (F.col("n") * entropy(inside(F.col("a"))))).alias("entropy_reduction"))


def draw_averages(draws: DataFrame, by: Sequence[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Mean over rows of each draw, then mean and quantiles over draws."""
    means = draws.groupBy("draw", *by).agg(F.avg("value").alias("m"))
    return means.groupBy(*by).agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(low)).alias("low"), F.percentile("m", F.lit(high)).alias("high"))


def draw_contrasts(draws: DataFrame, variable: str, kind: str = "pairwise", reference: object = None, rope: float = 0.1) -> DataFrame:
    """Differences of a variable's levels by draw: mean, probability of direction, share inside +-rope and the decision."""
    means = draws.groupBy("draw", F.col(variable).alias("level")).agg(F.avg("value").alias("m"))
    other = means.select("draw", F.col("level").alias("level2"), F.col("m").alias("m2"))
    order = {"pairwise": F.col("level2") > F.col("level"), "reference": (F.col("level") == F.lit(reference)) & (F.col("level2") != F.lit(reference)), "sequential": F.col("level2") == F.col("level") + 1}[kind]
    d = means.join(other, "draw").filter(order).withColumn("d", F.col("m2") - F.col("m"))
    out = d.groupBy("level", "level2").agg(F.avg("d").alias("mean"), F.greatest(F.avg((F.col("d") > 0).cast("int")), F.avg((F.col("d") < 0).cast("int"))).alias("direction"), F.avg((F.abs("d") <= rope).cast("int")).alias("inside"))
    return out.withColumn("decision", F.when(F.col("inside") >= 0.975, "equivalent").when(F.col("inside") <= 0.025, "different").otherwise("undecided"))


def envelope(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def variance_inflation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Diagonal of the inverse correlation matrix, tolerance and severity; one pass of sums, and a matrix of the columns on the driver."""
    rows = _complete(df, cols)
    r = rows.agg(*[F.corr(a, b).alias(f"{i}_{j}") for (i, a), (j, b) in combinations(list(enumerate(cols)), 2)]).first()
    m = np.eye(len(cols))
    for i, j in combinations(range(len(cols)), 2):
        m[i, j] = m[j, i] = r[f"{i}_{j}"]
    vif = np.diag(np.linalg.inv(m))
    return df.sparkSession.createDataFrame([(c, float(v), float(1 / v), "high" if v >= 10 else "moderate" if v >= 5 else "low") for c, v in zip(cols, vif, strict=True)], "variable string, vif double, tolerance double, severity string")


def principal_components(df: DataFrame, cols: Sequence[str], k: int, keep: Sequence[str] = ()) -> DataFrame:
    """Scores of k standardised principal components; each component's sign makes its largest loading positive."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=list(cols), outputCol="_x", handleInvalid="skip").transform(df)
    rows = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(rows).transform(rows)
    model = PCA(k=k, inputCol="_z", outputCol="_p").fit(rows)
    loading = model.pc.toArray()
    signs = [float(np.sign(loading[np.abs(loading[:, i]).argmax(), i])) for i in range(k)]
    scores = vector_to_array("_p")
    return model.transform(rows).select(*keep, *[(scores[i] * signs[i]).alias(f"pc{i + 1}") for i in range(k)])


def logit_exposure_response(df: DataFrame, y: str, x: Sequence[str], fold: str) -> DataFrame:
    """Out-of-fold predictions (p) of a binomial logit model, one fit for each fold; rows with NULL in x are left out.

    The fits take the counts of equal rows as weights, so the input is read twice whatever the number of folds,
    and the coefficients (a row for each fold) are joined to all rows.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = df.dropna(subset=list(x))
    counts = _settled(rows.groupBy(fold, F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in x]).agg(F.count("*").cast("double").alias("_n")))
    known = VectorAssembler(inputCols=list(x), outputCol="_x").transform(counts.dropna(subset=["_y"]))
    folds = sorted(r[0] for r in counts.select(fold).distinct().collect())
    fits = []
    for f in folds:
        model = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_x", labelCol="_y", weightCol="_n").fit(known.filter(F.col(fold) != f))
        fits.append((f, float(model.intercept), [float(c) for c in model.coefficients]))
    kind = counts.schema[fold].dataType.simpleString()
    table = df.sparkSession.createDataFrame(fits, f"`{fold}` {kind}, _b double, _w array<double>")
    eta = sum((F.get("_w", F.lit(i)) * F.col(c) for i, c in enumerate(x)), F.col("_b"))
    return rows.join(F.broadcast(table), fold).withColumn("p", 1 / (1 + F.exp(-eta))).drop("_b", "_w")


def calibration(df: DataFrame, y: str, mu: str, clip: float = 1e-6) -> DataFrame:
    """Intercept and slope of a logit fit of 0/1 outcomes on the logit of their predictions; 0 and 1 if these are calibrated."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    p = F.least(F.greatest(F.col(mu), F.lit(clip)), F.lit(1 - clip))
    rows = VectorAssembler(inputCols=["_l"], outputCol="_x").transform(df.select(F.col(y).cast("double").alias("_y"), F.log(p / (1 - p)).alias("_l")).dropna())
    model = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_x", labelCol="_y").fit(rows)
    return df.sparkSession.createDataFrame([(float(model.intercept), float(model.coefficients[0]))], "intercept double, slope double")


def trial_trend(df: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(y).alias("mean_change"), F.avg(x).alias("mean_x"), F.count("*").alias("n"))


def partial_correlation(df: DataFrame, x: str, y: str, z: str, semi: bool = True) -> DataFrame:
    """Spearman correlation of x and y with z taken out of x (semi) or of both."""
    rows = _complete(df, [x, y, z])
    for c in (x, y, z):
        rows = mean_ranks(rows, c, f"_r_{c}")
    r = rows.agg(F.corr(f"_r_{x}", f"_r_{y}").alias("xy"), F.corr(f"_r_{x}", f"_r_{z}").alias("xz"), F.corr(f"_r_{y}", f"_r_{z}").alias("yz"), F.count("*").alias("n"))
    below = F.sqrt(1 - F.col("xz") * F.col("xz")) * (F.lit(1.0) if semi else F.sqrt(1 - F.col("yz") * F.col("yz")))
    return r.select("n", ((F.col("xy") - F.col("xz") * F.col("yz")) / below).alias("r"))


def partial_correlations(df: DataFrame, xs: Sequence[str], ys: Sequence[str], covariates: Sequence[str], semi: bool = True) -> DataFrame:
    """x, y, r, n of every pair, with any number of covariates taken out of x (semi) or of both, by ranks.

    All rank correlations come from one aggregate; each pair then solves a system as small as the covariates.
    """
    cols = list(dict.fromkeys([*xs, *ys, *covariates]))
    rows = _complete(df, cols)
    for c in cols:
        rows = mean_ranks(rows, c, f"_r_{c}")
    pairs = list(combinations(cols, 2))
    found = rows.agg(F.count("*").alias("n"), *[F.corr(f"_r_{a}", f"_r_{b}").alias(f"_{i}") for i, (a, b) in enumerate(pairs)]).first()
    r = {(a, a): 1.0 for a in cols} | {p: found[f"_{i}"] for i, (a, b) in enumerate(pairs) for p in ((a, b), (b, a))}
    z = np.linalg.pinv(np.array([[r[a, b] if r[a, b] is not None else np.nan for b in covariates] for a in covariates])) if covariates else np.zeros((0, 0))
    out = []
    for x in xs:
        for y in ys:
            cx, cy = (np.array([r[v, c] for c in covariates], float) for v in (x, y))
            left = (1 - cx @ z @ cx) * (1.0 if semi else 1 - cy @ z @ cy)
            out.append((x, y, float((r[x, y] - cx @ z @ cy) / np.sqrt(left)) if left > 0 else None, found["n"]))
    return df.sparkSession.createDataFrame(out, "x string, y string, r double, n long")


def empirical_thresholds(df: DataFrame, rating: str, by: Sequence[str]) -> DataFrame:
    """Logit of the cumulative share of each ordered rating; the last one, which is infinite, is left out."""
    counts = df.filter(F.col(rating).isNotNull()).groupBy(*by, rating).agg(F.count("*").alias("k"))
    w = W.Window.partitionBy(*by)
    p = F.sum("k").over(w.orderBy(rating)) / F.sum("k").over(w)
    return counts.withColumn("share", p).filter("share < 1").select(*by, rating, F.log(F.col("share") / (1 - F.col("share"))).alias("threshold"))


def simple_regression(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
