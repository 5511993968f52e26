"""Models of ratings by participants: elastic-net selection, estimating equations with exchangeable correlation, random intercepts.

Rows enter as sums of products by participant, one shuffle with partial sums, so that a participant of any size is
never gathered. What reaches the driver has the size of the columns (and of stated parameters), not of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import shared_folder, ship_package


def _settled(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _complete(df: DataFrame, y: str, x: Sequence[str], who: str, *more: str) -> DataFrame:
    """who, more, _y and _x0 (1), _x1, ...: rows without NULL in any of them."""
    kept = df.select(F.col(who).alias("_who"), *more, F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("_x0"), *[F.col(c).cast("double").alias(f"_x{i + 1}") for i, c in enumerate(x)])
    return kept.dropna()


def _upper(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]


def _symmetric(values: Sequence[float], n: int) -> np.ndarray:
    out = np.zeros((n, n))
    for (i, j), v in zip(_upper(n), values, strict=True):
        out[i, j] = out[j, i] = v
    return out


# elastic net


def poisson_weights(keys: np.ndarray, draws: int) -> np.ndarray:
    """Poisson(1) multiplicities of 64-bit keys (rows) in each of `draws` resamples (columns), by a hash of both."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64)[:, None] + np.arange(1, draws + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53
    chances = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
    return np.searchsorted(chances, u, side="right").astype(float)


def standardised(moments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Correlations among columns, covariances of these with y, means, deviations and mean of y from the second moments of (1, x..., y); a constant column has deviation 0."""
    n = max(moments[0, 0], 1e-300)
    mean = moments[0, 1:] / n
    cov = moments[1:, 1:] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
    scale[scale <= 1e-12 * (1 + np.abs(mean[:-1]))] = 0
    by = np.where(scale > 0, 1 / np.where(scale > 0, scale, 1), 0)
    return cov[:-1, :-1] * np.outer(by, by), cov[:-1, -1] * by, mean[:-1], scale, float(mean[-1])


def elastic_net_path(gram: np.ndarray, target: np.ndarray, penalties: np.ndarray, alpha: float, tolerance: float = 1e-10, rounds: int = 10_000) -> np.ndarray:
    """Coefficients (a row for each penalty) of least half the mean squared error + penalty (alpha |b| + (1 - alpha) b^2 / 2), by coordinate descent on standardised sums; each penalty starts where the one before ended."""
    out, b = np.zeros((len(penalties), len(target))), np.zeros(len(target))
    for k, penalty in enumerate(penalties):
        for _ in range(rounds):
            moved = 0.0
            for j in np.flatnonzero(np.diag(gram) > 0):
                free = target[j] - gram[j] @ b + gram[j, j] * b[j]
                new = math.copysign(max(0.0, abs(free) - penalty * alpha), free) / (gram[j, j] + penalty * (1 - alpha))
                moved, b[j] = max(moved, abs(new - b[j])), new
            if moved < tolerance:
                break
        out[k] = b
    return out


def fold_moments(df: DataFrame, y: str, x: Sequence[str], who: str, fold: str, resamples: int, seed: int = 808) -> DataFrame:
    """fold, draw (0: every participant once; 1 to resamples: Poisson multiplicities), m: upper triangle of the second moments of (1, x..., y).

    One pass: products are summed by participant, and a task weighs the participants that it holds for all draws at
    once, so at most folds x (resamples + 1) rows a task are shuffled on.
    """
    ship_package(df.sparkSession)
    columns = [f"_x{i}" for i in range(len(x) + 1)] + ["_y"]
    pairs = _upper(len(columns))
    rows = _complete(df, y, x, who, F.col(fold).cast("int").alias("fold"))
    own = rows.groupBy("_who", "fold").agg(F.array(*[F.sum(F.col(columns[i]) * F.col(columns[j])) for i, j in pairs]).alias("m"))
    size = len(pairs)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            keys, folds = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(keys), size)
            weights = np.hstack([np.ones((len(keys), 1)), poisson_weights(keys, resamples)])
            for f in np.unique(folds):
                sums[int(f)] = sums.get(int(f), 0) + weights[folds == f].T @ values[folds == f]
        out = [(f, d, m.tolist()) for f, all_ in sums.items() for d, m in enumerate(all_)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.list_(pa.float64())))], ["fold", "draw", "m"])

    keyed = own.select(F.xxhash64(F.lit(seed), "_who").alias("key"), "fold", "m")
    dealt = keyed.mapInArrow(weigh, "fold int, draw int, m array<double>")
    return dealt.groupBy("fold", "draw").agg(F.array(*[F.sum(F.get("m", F.lit(i))) for i in range(size)]).alias("m"))


def elastic_net_selection(df: DataFrame, y: str, x: Sequence[str], who: str, fold: str, alpha: float = 0.5, penalties: int = 40, resamples: int = 50, least: float = 0.6, seed: int = 808) -> DataFrame:
    """variable, coefficient, penalty, folds (that select it), share (of all folds' resamples that do), kept (share at least `least`).

    Folds hold whole participants. The penalty is that of least error over the folds left out, of a falling path
    from the first that leaves nothing; coefficients are of all rows, in the columns' units. Resamples draw
    participants. Rows with NULL take no part; a constant column is never selected; without rows, or with one fold
    only, there is no row. Neither folds, penalties nor resamples take another pass over the rows: a fold's
    training sums are the whole's less its own, and the errors come from its own.
    """
    ship_package(df.sparkSession)
    p, names = len(x), list(x)
    schema = "variable string, coefficient double, penalty double, folds long, share double, kept boolean"
    sums = _settled(fold_moments(df, y, x, who, fold, resamples, seed))
    plain = {r["fold"]: _symmetric(r["m"], p + 2) for r in sums.filter("draw = 0").orderBy("fold").collect()}
    if len(plain) < 2:
        return df.sparkSession.createDataFrame([], schema)
    whole = sum(plain.values())
    gram, target, mean, scale, centre = standardised(whole)
    first = np.abs(target).max() / max(alpha, 1e-3)
    path = np.geomspace(max(first, 1e-12), max(first, 1e-12) * 1e-3, penalties)
    error, chosen = np.zeros(penalties), []
    for own in plain.values():
        g, t, m, s, c = standardised(whole - own)
        slopes = elastic_net_path(g, t, path, alpha) * np.where(s > 0, 1 / np.where(s > 0, s, 1), 0)
        full = np.hstack([(c - slopes @ m)[:, None], slopes, np.full((penalties, 1), -1.0)])  # residual of (1, x, y), sign turned
        error += np.einsum("ki,ij,kj->k", full, own, full)
        chosen.append(slopes != 0)
    best = int(error.argmin())
    at_best = path[: best + 1]

    # every training set of every draw is fitted in a task of its own row
    total = sums.groupBy("draw").agg(F.array(*[F.sum(F.get("m", F.lit(i))) for i in range(len(_upper(p + 2)))]).alias("all"))
    train = sums.filter("draw > 0").join(F.broadcast(total), "draw").select("fold", "draw", F.zip_with("all", "m", lambda a, b: a - b).alias("m"))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for m in batch.column(0).to_pylist():
                g, t, *_ = standardised(_symmetric(m, p + 2))
                hits.append((elastic_net_path(g, t, at_best, alpha)[-1] != 0).astype(float).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.float64()))], ["hits"])

    shares = train.repartition(32, "fold", "draw").select("m").mapInArrow(fitted, "hits array<double>").agg(*[F.avg(F.get("hits", F.lit(i))).alias(f"_{i}") for i in range(p)]).first() if resamples else [0.0] * p
    slopes = elastic_net_path(gram, target, at_best, alpha)[-1] * np.where(scale > 0, 1 / np.where(scale > 0, scale, 1), 0)
    rows = [(names[i], float(slopes[i]), float(path[best]), int(sum(c[best, i] for c in chosen)), float(shares[i] or 0), bool((shares[i] or 0) >= least)) for i in range(p)]
    return df.sparkSession.createDataFrame(rows, schema)


# estimating equations


class Marginal:
    """A marginal model whose rows correlate alike within a participant, by Fisher scoring.

    The inverse of an exchangeable block is I less a multiple of the ones, so a participant enters by its sums (of
    weighted columns, residuals and products), two aggregates a round: by participant, and over all. family: binomial
    (logit link) or gaussian (identity); correlation: exchangeable or independence (rho 0, the plain model with
    sandwich errors). Rows with NULL take no part. Collinear columns take the least coefficients; rounds that don't
    settle are an error.
    """

    def __init__(self, df: DataFrame, y: str, x: Sequence[str], who: str, family: str = "binomial", correlation: str = "exchangeable", rounds: int = 50, tolerance: float = 1e-9):
        self.x, self.who, self.p, self.family = list(x), who, len(x) + 1, family
        self.columns = [f"_x{i}" for i in range(self.p)]
        self.rows = _settled(_complete(df, y, x, who).groupBy("_who", "_y", *self.columns).agg(F.count("*").cast("double").alias("_k")))  # equal rows once
        n, self.clusters, pairs_in, total = self.rows.groupBy("_who").agg(F.sum("_k").alias("n"), F.sum(F.col("_k") * F.col("_y")).alias("s")).agg(F.sum("n"), F.count("*"), F.sum(F.col("n") * (F.col("n") - 1) / 2), F.sum("s")).first()
        self.n, p, upper = n or 0, self.p, _upper(self.p)
        if not n:
            return
        share = total / n
        self.beta, self.rho = np.zeros(p), 0.0
        self.beta[0] = math.log(min(max(share, 1e-6), 1 - 1e-6) / (1 - min(max(share, 1e-6), 1 - 1e-6))) if family == "binomial" else share
        for _ in range(rounds):
            w, h = self._score(), self._bread()
            sums = self._people().agg(
                F.sum("q").alias("q"), F.sum((F.col("e") * F.col("e") - F.col("q")) / 2).alias("cross"), *[F.sum(w[i]).alias(f"g{i}") for i in range(p)],
                *[F.sum(c).alias(f"h{i}") for i, c in enumerate(h)], *[F.sum(w[i] * w[j]).alias(f"b{i}_{j}") for i, j in upper],
            ).first()
            self.information = _symmetric([sums[f"h{i}"] for i in range(len(upper))], p)
            self.inverse = np.linalg.pinv(self.information)
            step = self.inverse @ np.array([sums[f"g{i}"] for i in range(p)])
            self.dispersion = sums["q"] / max(1.0, n - p)
            new = sums["cross"] / max(1.0, pairs_in - p) / self.dispersion if correlation == "exchangeable" and pairs_in and self.dispersion > 0 else 0.0
            new = min(max(new, -0.99 / max(1.0, 2 * pairs_in / n)), 0.99)
            if np.abs(step).max() < tolerance * (1 + np.abs(self.beta).max()) and abs(new - self.rho) < tolerance:
                break
            self.beta, self.rho = self.beta + step, new
        else:
            raise RuntimeError(f"the estimating equations didn't settle in {rounds} rounds")
        self.meat = _symmetric([sums[f"b{i}_{j}"] for i, j in upper], p)

    def _people(self) -> DataFrame:
        """_who, n, e and q (sums of Pearson residuals and their squares), s, u and m (sums of weighted columns, of columns times residuals and of products) at the present coefficients."""
        eta = sum((float(b) * F.col(c) for b, c in zip(self.beta, self.columns, strict=True)), F.lit(0.0))
        held = self.rows.withColumn("_m", 1 / (1 + F.exp(-eta)) if self.family == "binomial" else eta)
        held = held.withColumn("_v", F.greatest(F.col("_m") * (1 - F.col("_m")), F.lit(1e-12)) if self.family == "binomial" else F.lit(1.0)).withColumn("_r", F.col("_y") - F.col("_m"))
        k, v, r = F.col("_k"), F.col("_v"), F.col("_r")
        return held.groupBy("_who").agg(
            F.sum(k).alias("n"), F.sum(k * r / F.sqrt(v)).alias("e"), F.sum(k * r * r / v).alias("q"),
            *[F.sum(k * F.sqrt(v) * F.col(c)).alias(f"s{i}") for i, c in enumerate(self.columns)],
            *[F.sum(k * r * F.col(c)).alias(f"u{i}") for i, c in enumerate(self.columns)],
            *[F.sum(k * v * F.col(self.columns[i]) * F.col(self.columns[j])).alias(f"m{i}_{j}") for i, j in _upper(self.p)],
        )

    def _ones(self) -> Column:
        """What the ones are multiplied by in the inverse of a participant's block."""
        return self.rho / (1 + (F.col("n") - 1) * self.rho)

    def _score(self) -> list[Column]:
        return [F.col(f"u{i}") - self._ones() * F.col(f"s{i}") * F.col("e") for i in range(self.p)]

    def _bread(self) -> list[Column]:
        return [F.col(f"m{i}_{j}") - self._ones() * F.col(f"s{i}") * F.col(f"s{j}") for i, j in _upper(self.p)]

    def coefficients(self) -> DataFrame:
        """term, coefficient, robust_se, naive_se, z, rho, dispersion, clusters; no row without rows."""
        schema = "term string, coefficient double, robust_se double, naive_se double, z double, rho double, dispersion double, clusters long"
        if not self.n:
            return self.rows.sparkSession.createDataFrame([], schema)
        robust = np.sqrt(np.maximum(np.diag(self.inverse @ self.meat @ self.inverse), 0))
        naive = np.sqrt(np.maximum(np.diag(self.inverse) * self.dispersion * (1 - self.rho), 0))
        out = [(t, float(b), float(s), float(a), float(b / s) if s > 0 else None, float(self.rho), float(self.dispersion), self.clusters) for t, b, s, a in zip(["(intercept)", *self.x], self.beta, robust, naive, strict=True)]
        return self.rows.sparkSession.createDataFrame(out, schema)

    def influence(self) -> DataFrame:
        """who, n, mahalanobis (squared distance of a participant's residuals under its block) and cook (how far the coefficients move, one step, without it, per coefficient and in their own covariance).

        Each participant's sums are taken off the whole's, and its small system is solved where its row is.
        """
        spark, p, upper = self.rows.sparkSession, self.p, _upper(self.p)
        kind = self.rows.schema["_who"].dataType.simpleString()
        schema = f"`{self.who}` {kind}, n long, mahalanobis double, cook double"
        if not self.n:
            return spark.createDataFrame([], schema)
        ship_package(spark)
        whole, scale = self.information, self.dispersion * (1 - self.rho)
        distance = (F.col("q") - self._ones() * F.col("e") * F.col("e")) / scale
        rows = self._people().select("_who", F.col("n").cast("long").alias("n"), distance.alias("mahalanobis"), F.array(*self._score()).alias("w"), F.array(*self._bread()).alias("h"))

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                w = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(n, p)
                h = np.zeros((n, p, p))
                for k, (i, j) in enumerate(upper):
                    h[:, i, j] = h[:, j, i] = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)[:, k]
                moved = (np.linalg.pinv(whole[None] - h) @ w[:, :, None])[:, :, 0]
                cook = np.einsum("ni,ij,nj->n", moved, whole, moved) / (p * scale)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cook)], [self_who, "n", "mahalanobis", "cook"])

        self_who = self.who
        return rows.mapInArrow(solve, schema)


def gee(df: DataFrame, y: str, x: Sequence[str], who: str, family: str = "binomial", correlation: str = "exchangeable") -> DataFrame:
    """The coefficients of a Marginal model."""
    return Marginal(df, y, x, who, family, correlation).coefficients()


# random intercepts


class RandomIntercept:
    """Linear model with an intercept drawn for each participant, by restricted likelihood.

    One aggregate sums the columns by participant. The likelihood of a variance ratio depends on a participant
    only by its number of rows and its sums, so participants of one size are summed once more; every further step
    reads that table (a row for each size), for a whole grid of ratios at a time.
    """

    def __init__(self, df: DataFrame, y: str, x: Sequence[str], who: str, refinements: int = 7):
        self.x, self.who, p = list(x), who, len(x) + 1
        self.columns = [*(f"_x{i}" for i in range(p)), "_y"]
        pairs = _upper(p + 1)
        rows = _complete(df, y, x, who)
        self.people = _settled(rows.groupBy("_who").agg(F.count("*").cast("double").alias("n"), *[F.sum(c).alias(c) for c in self.columns]))
        product = lambda i, j: F.sum(F.col(self.columns[i]) * F.col(self.columns[j])).alias(f"{i}_{j}")
        whole = rows.agg(F.count("*").alias("n"), *[product(i, j) for i, j in pairs]).first()
        self.sizes = _settled(self.people.groupBy("n").agg(F.count("*").cast("double").alias("k"), *[product(i, j) for i, j in pairs]))
        self.n, self.p = whole["n"], p
        if not self.n:
            return
        total = _symmetric([whole[f"{i}_{j}"] for i, j in pairs], p + 1)
        low, high = -12.0, 8.0  # logarithms of the ratio
        for _ in range(refinements):
            grid = [math.exp(t) for t in np.linspace(low, high, 25)]
            fits = self._profiles([0.0, *grid], total)
            best = max(range(len(fits)), key=lambda i: fits[i][0])
            step = (high - low) / 24
            centre = low + (best - 1) * step if best else low
            low, high = centre - step, centre + step
        self.likelihood, self.ratio, self.beta, self.inverse, self.residual = fits[best]

    def _profiles(self, ratios: list[float], total: np.ndarray) -> list[tuple]:
        """Restricted log likelihood, ratio, coefficients, inverse and residual variance for each ratio of intercept to residual variance."""
        p, pairs = self.p, _upper(self.p + 1)
        exploded = self.sizes.withColumn("t", F.explode(F.array(*map(F.lit, ratios))))
        c = F.col("t") / (1 + F.col("n") * F.col("t"))
        sums = exploded.groupBy("t").agg(F.sum(F.col("k") * F.log1p(F.col("n") * F.col("t"))).alias("logs"), *[F.sum(c * F.col(f"{i}_{j}")).alias(f"{i}_{j}") for i, j in pairs])
        found = {r["t"]: r for r in sums.collect()}
        out = []
        for t in ratios:
            a = total - _symmetric([found[t][f"{i}_{j}"] for i, j in pairs], p + 1)
            inverse = np.linalg.pinv(a[:p, :p])
            beta = inverse @ a[:p, p]
            rss = max(a[p, p] - beta @ a[:p, p], 1e-300)
            variance = rss / max(1, self.n - p)
            _, logdet = np.linalg.slogdet(a[:p, :p])
            out.append((-0.5 * ((self.n - p) * math.log(variance) + found[t]["logs"] + logdet), t, beta, inverse, variance))
        return out

    def coefficients(self) -> DataFrame:
        """term, coefficient, se, t, residual_variance, intercept_variance, icc; no row without rows."""
        schema = "term string, coefficient double, se double, t double, residual_variance double, intercept_variance double, icc double"
        if not self.n:
            return self.people.sparkSession.createDataFrame([], schema)
        se = np.sqrt(np.maximum(np.diag(self.inverse) * self.residual, 0))
        between = self.ratio * self.residual
        rows = [(name, float(b), float(s), float(b / s) if s > 0 else None, float(self.residual), float(between), float(between / (between + self.residual))) for name, b, s in zip(["(intercept)", *self.x], self.beta, se, strict=True)]
        return self.people.sparkSession.createDataFrame(rows, schema)

    def intercepts(self) -> DataFrame:
        """who, n, intercept: each participant's mean residual, shrunken towards 0 the more the fewer rows it has."""
        rows = self.people.withColumnRenamed("_who", self.who)
        if not self.n:
            return rows.select(self.who, F.col("n").cast("long").alias("n"), F.lit(0.0).alias("intercept"))
        left: Column = F.col("_y") - sum((float(b) * F.col(c) for b, c in zip(self.beta, self.columns, strict=False)), F.lit(0.0))
        return rows.select(self.who, F.col("n").cast("long").alias("n"), (self.ratio * left / (1 + F.col("n") * self.ratio)).alias("intercept"))


# sigmoids


def sigmoid_fits(df: DataFrame, keys: Sequence[str], x: str, y: str, start: Sequence[float] = (1.0, 0.0, 6.0), low: Sequence[float] = (0.0, 0.0, 1e-12), high: Sequence[float] = (10.0, 10.0, 10.0), rounds: int = 60, tolerance: float = 1e-10) -> DataFrame:
    """keys, q, k, v, n, r2, rse, settled: least squares of y = (1 + q exp(-k x)) ** (-1 / v) in each group, within bounds.

    Damped Gauss-Newton steps for all groups at once: a round sums residuals and slopes over the counts of equal
    (x, y) of each group at its trial parameters, takes or rejects these, and makes the next trial, so that a group
    of any size is summed where its rows are. Parameters at a bound that the slope pushes against stay there and
    count as fixed in the degrees of freedom. Rows with NULL in x or y take no part; a group without others has no
    row; NULL keys are a group. settled is false where `rounds` were not enough.
    """
    ship_package(df.sparkSession)
    counts = df.select(F.struct(*[F.col(c).alias(c) for c in keys]).alias("_key"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna(subset=["_x", "_y"])
    counts = _settled(counts.groupBy("_key", "_x", "_y").agg(F.count("*").cast("double").alias("_n")))
    bounds = np.array(low, float), np.array(high, float)
    array = lambda values: F.array(*[F.lit(float(v)) for v in values])
    state = counts.groupBy("_key").agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_y")).alias("_s"), F.sum(F.col("_n") * F.col("_y") * F.col("_y")).alias("_q"))
    state = _settled(state.select("_key", "n", (F.col("_q") - F.col("_s") * F.col("_s") / F.col("n")).alias("total"), array(start).alias("at"), array(start).alias("trial"), F.lit(float("inf")).alias("sse"), array([0] * 9).alias("slopes"), F.lit(1e-3).alias("damping"), F.lit(False).alias("settled")))
    q, k, v = (F.get("trial", F.lit(i)) for i in range(3))
    e = F.exp(-k * F.col("_x"))
    base = 1 + q * e
    value = F.pow(base, -1 / v)
    slopes = [-value * e / (v * base), value * q * F.col("_x") * e / (v * base), value * F.log(base) / (v * v)]
    schema = state.schema

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not r["settled"]:
                    if r["found"][0] < r["sse"]:
                        gain = (r["sse"] - r["found"][0]) / max(r["found"][0], 1e-300) if np.isfinite(r["sse"]) else np.inf
                        r |= {"at": r["trial"], "sse": r["found"][0], "slopes": r["found"][1:], "damping": max(r["damping"] / 3, 1e-12), "settled": gain < tolerance}
                    else:
                        r["damping"] *= 4
                    at, g, h = np.array(r["at"]), np.array(r["slopes"][:3]), _symmetric(r["slopes"][3:], 3)
                    fixed = ((at <= bounds[0]) & (g < 0)) | ((at >= bounds[1]) & (g > 0))
                    h[fixed], h[:, fixed], g[fixed] = 0, 0, 0
                    h += np.diag(r["damping"] * np.maximum(np.diag(h), 1e-12) + fixed)
                    trial = np.clip(at + np.linalg.solve(h, g), *bounds)
                    r["settled"] = bool(r["settled"] or r["damping"] > 1e12 or np.abs(trial - at).max() <= 1e-13)
                    r["trial"] = trial.tolist()
                out.append({c: r[c] for c in schema.names})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([batch.schema.field(c) for c in schema.names]))

    for _ in range(rounds):
        rest = F.col("_y") - value
        held = counts.join(state.filter("NOT settled").select("_key", "trial"), "_key")
        found = held.groupBy("_key").agg(F.array(F.sum(F.col("_n") * rest * rest), *[F.sum(F.col("_n") * rest * s) for s in slopes], *[F.sum(F.col("_n") * slopes[i] * slopes[j]) for i, j in _upper(3)]).alias("found"))
        state = _settled(state.join(found, "_key", "left").select(*schema.names, "found").mapInArrow(advance, schema))
        if not state.filter("NOT settled").head(1):
            break
    near = lambda i: sum((F.abs(F.get("at", F.lit(i)) - b[i]) <= 1e-8 + 1e-5 * abs(b[i])).cast("int") for b in bounds)
    free = F.col("n") - 3 + near(0) + near(1) + near(2)
    return state.select(*[F.col(f"_key.{c}").alias(c) for c in keys], *[F.get("at", F.lit(i)).alias(c) for i, c in enumerate("qkv")], F.col("n").cast("long").alias("n"), F.when(F.col("total") > 0, 1 - F.col("sse") / F.col("total")).alias("r2"), F.when(free > 0, F.sqrt(F.col("sse") / free)).alias("rse"), "settled")
