"""Elastic net, estimating equations and random intercepts against plain numpy on the rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonora.operators import models as M
from sonora.operators import stats as S


@pytest.fixture(scope="module")
def rows():
    """(who, fold, y, binary, a, b, c, constant) of 60 participants, one with a third of all rows."""
    rng = np.random.default_rng(11)
    out = []
    for who in range(60):
        own, tilt = 150 if who == 7 else int(rng.integers(1, 9)), rng.normal()
        for _ in range(own):
            a, b, c = rng.normal(size=3)
            y = 1.0 + 0.8 * a - 0.5 * b + tilt + rng.normal()
            out.append((who, who % 4, float(y), float(rng.random() < 1 / (1 + math.exp(-(0.3 + 0.9 * a + tilt)))), float(a), float(b), float(c + 0.4 * a), 2.0))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    out = spark.createDataFrame(rows, "who long, fold int, y double, binary double, a double, b double, c double, constant double").repartition(3)
    missing = spark.createDataFrame([(1, 1, None, None, 1.0, 1.0, 1.0, 2.0), (None, 1, 5.0, 1.0, 1.0, 1.0, 1.0, 2.0), (2, 2, 5.0, 1.0, None, 1.0, 1.0, 2.0)], out.schema)
    return out.unionByName(missing).withColumn("_y", F.lit("clash")).withColumn("n", F.lit(0))


def plain_net(x, y, weight, penalty, alpha, rounds=20_000):
    """Proximal steps on standardised rows: another algorithm for the same minimum."""
    w = weight / weight.sum()
    mean, sd = w @ x, np.sqrt(w @ (x - w @ x) ** 2)
    use = sd > 1e-9
    z, t = (x[:, use] - mean[use]) / sd[use], y - w @ y
    g, c = z.T @ (w[:, None] * z), z.T @ (w * t)
    step, b = 1 / (np.linalg.eigvalsh(g).max() + penalty), np.zeros(use.sum())
    for _ in range(rounds):
        v = b - step * (g @ b - c + penalty * (1 - alpha) * b)
        b = np.sign(v) * np.maximum(0, np.abs(v) - step * penalty * alpha)
    out = np.zeros(x.shape[1])
    out[use] = b / sd[use]
    return out


def test_elastic_net_equals_fits_on_rows(spark, df, rows):
    x = np.array([r[4:8] for r in rows])
    y, fold, who = np.array([r[2] for r in rows]), np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    names, resamples = ["a", "b", "c", "constant"], 12
    out = {r["variable"]: r for r in M.elastic_net_selection(df, "y", names, "who", "fold", resamples=resamples).collect()}
    one = np.ones(len(y))
    z = (x[:, :3] - x[:, :3].mean(0)) / x[:, :3].std(0)
    path = np.geomspace(1, 1e-3, 40) * np.abs(z.T @ (y - y.mean()) / len(y)).max() / 0.5
    error, chosen = np.zeros(40), []
    for f in range(4):
        k = fold != f
        fits = [plain_net(x[k], y[k], one[k], t, 0.5, 3000) for t in path]
        error += [np.square(y[~k] - (y[k].mean() + (x[~k] - x[k].mean(0)) @ b)).sum() for b in fits]
        chosen.append([b != 0 for b in fits])
    best = int(error.argmin())
    assert out["a"]["penalty"] == pytest.approx(path[best])
    want = plain_net(x, y, one, path[best], 0.5)
    assert [out[n]["coefficient"] for n in names] == pytest.approx(list(want), abs=1e-6)
    assert [out[n]["folds"] for n in names] == [sum(c[best][i] for c in chosen) for i in range(4)]
    keys = {r["who"]: r["k"] for r in df.select("who", F.xxhash64(F.lit(808), "who").alias("k")).dropna().collect()}
    draws = M.poisson_weights(np.array([keys[w] for w in who]), resamples)
    hits = np.array([plain_net(x[fold != f], y[fold != f], draws[fold != f, d], path[best], 0.5, 3000) != 0 for f in range(4) for d in range(resamples)])
    assert [out[n]["share"] for n in names] == pytest.approx(list(hits.mean(0)), abs=0.03)
    assert out["constant"]["coefficient"] == 0 and not out["constant"]["kept"] and out["a"]["kept"]


def test_poisson_weights_are_poisson():
    w = M.poisson_weights(np.arange(20_000), 5)
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.03)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03


def plain_gee(x, y, who, binomial, exchangeable):
    """The same equations with whole blocks, inverted as matrices."""
    x = np.column_stack([np.ones(len(y)), x])
    groups = [np.flatnonzero(who == w) for w in np.unique(who)]
    beta, rho, n, p = np.zeros(x.shape[1]), 0.0, *x.shape
    for _ in range(200):
        mu = 1 / (1 + np.exp(-x @ beta)) if binomial else x @ beta
        v = mu * (1 - mu) if binomial else np.ones(n)
        pearson = (y - mu) / np.sqrt(v)
        phi = (pearson**2).sum() / (n - p)
        if exchangeable:
            rho = sum((pearson[g].sum() ** 2 - (pearson[g] ** 2).sum()) / 2 for g in groups) / (sum(len(g) * (len(g) - 1) / 2 for g in groups) - p) / phi
        h, s, meat = np.zeros((p, p)), np.zeros(p), np.zeros((p, p))
        for g in groups:
            d = x[g] * v[g][:, None]
            a = np.diag(np.sqrt(v[g]))
            inverse = np.linalg.inv(phi * a @ (np.full((len(g), len(g)), rho) + (1 - rho) * np.eye(len(g))) @ a)
            u = d.T @ inverse @ (y[g] - mu[g])
            h, s, meat = h + d.T @ inverse @ d, s + u, meat + np.outer(u, u)
        step = np.linalg.solve(h, s)
        beta = beta + step
        if np.abs(step).max() < 1e-12:
            break
    bread = np.linalg.inv(h)
    return beta, np.sqrt(np.diag(bread @ meat @ bread)), np.sqrt(np.diag(bread)), rho, phi


@pytest.mark.parametrize("family,correlation", [("binomial", "exchangeable"), ("binomial", "independence"), ("gaussian", "exchangeable")])
def test_gee_equals_whole_blocks(df, rows, family, correlation):
    target = "binary" if family == "binomial" else "y"
    out = M.gee(df, target, ["a", "b"], "who", family, correlation).collect()
    y = np.array([r[3] if family == "binomial" else r[2] for r in rows])
    beta, robust, naive, rho, phi = plain_gee(np.array([r[4:6] for r in rows]), y, np.array([r[0] for r in rows]), family == "binomial", correlation == "exchangeable")
    assert [r["term"] for r in out] == ["(intercept)", "a", "b"]
    assert [r["coefficient"] for r in out] == pytest.approx(list(beta), abs=1e-6)
    assert [r["robust_se"] for r in out] == pytest.approx(list(robust), rel=1e-5)
    assert [r["naive_se"] for r in out] == pytest.approx(list(naive), rel=1e-5)
    assert out[0]["rho"] == pytest.approx(rho, abs=1e-6) and out[0]["dispersion"] == pytest.approx(phi, rel=1e-6) and out[0]["clusters"] == 60


@pytest.mark.parametrize("family", ["binomial", "gaussian"])
def test_influence_equals_fits_without_each_participant(df, rows, family):
    model = M.Marginal(df, "binary" if family == "binomial" else "y", ["a", "b"], "who", family)
    out = {r["who"]: r for r in model.influence().collect()}
    x = np.column_stack([np.ones(len(rows)), [r[4:6] for r in rows]])
    y, who = np.array([r[3] if family == "binomial" else r[2] for r in rows]), np.array([r[0] for r in rows])
    mu = 1 / (1 + np.exp(-x @ model.beta)) if family == "binomial" else x @ model.beta
    v = mu * (1 - mu) if family == "binomial" else np.ones(len(y))
    part = {}
    for w in np.unique(who):
        g = np.flatnonzero(who == w)
        a = np.diag(np.sqrt(v[g]))
        inverse = np.linalg.inv(model.dispersion * a @ (np.full((len(g), len(g)), model.rho) + (1 - model.rho) * np.eye(len(g))) @ a)
        d, r = x[g] * v[g][:, None], y[g] - mu[g]
        part[w] = d.T @ inverse @ d, d.T @ inverse @ r, r @ inverse @ r, len(g)
    whole = sum(p[0] for p in part.values())
    for w, (h, u, far, n) in part.items():
        moved = np.linalg.solve(whole - h, u)
        assert out[w]["n"] == n and out[w]["mahalanobis"] == pytest.approx(far, rel=1e-6)
        assert out[w]["cook"] == pytest.approx(moved @ whole @ moved / 3, rel=1e-5, abs=1e-9)
    if family == "gaussian":  # with the block's shape held, the step is the fit without the participant
        keep = who != 7
        again = np.linalg.solve(sum(p[0] for w, p in part.items() if w != 7), sum(p[1] for w, p in part.items() if w != 7))
        assert keep.any() and np.abs(again + np.linalg.solve(whole - part[7][0], part[7][1])).max() < 1e-6


def plain_sigmoid(x, y, starts):
    """Least squares by many small projected steps from several starts, polished by shrinking random moves."""
    low, high = np.array([0, 0, 1e-12]), np.array([10.0, 10, 10])
    loss = lambda p: np.square(y - (1 + p[0] * np.exp(-p[1] * x)) ** (-1 / p[2])).sum()
    rng, best = np.random.default_rng(1), None
    for s in starts:
        p, f, size = np.array(s, float), loss(np.array(s, float)), 1.0
        for i in range(40_000):
            trial = np.clip(p + size * rng.normal(size=3) * rng.integers(0, 2, 3), low + 1e-9, high)
            if (g := loss(trial)) < f:
                p, f = trial, g
            elif i % 60 == 59:
                size = max(size * 0.95, 1e-7)
        if best is None or f < best:
            best = f
    return best


def test_sigmoids_fit_as_well_as_a_search(spark):
    rng = np.random.default_rng(3)
    rows, truth = [], {"a": (5.0, 0.6, 1.0), "b": (2.0, 1.5, 0.7), None: (8.0, 0.3, 2.0), "flat": (0.0, 1.0, 1.0)}
    for g, (q, k, v) in truth.items():
        for _ in range(150):
            x = float(np.round(rng.uniform(0, 12), 1))
            rows.append((g, x, float((1 + q * np.exp(-k * x)) ** (-1 / v) + (rng.normal() * 0.05 if g != "flat" else 0))))
    rows += [("a", None, 1.0), ("none", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(3)
    out = {r["g"]: r for r in M.sigmoid_fits(df, ["g"], "x", "y").collect()}
    assert out.keys() == truth.keys() and all(r["n"] == 150 and r["settled"] for r in out.values())
    for g in ("a", "b", None):
        x, y = (np.array([r[i] for r in rows if r[0] == g and r[1] is not None]) for i in (1, 2))
        r = out[g]
        sse = np.square(y - (1 + r["q"] * np.exp(-r["k"] * x)) ** (-1 / r["v"])).sum()
        assert sse <= plain_sigmoid(x, y, [truth[g], (1, 1, 1)]) * (1 + 1e-5)
        assert r["r2"] == pytest.approx(1 - sse / np.square(y - y.mean()).sum(), abs=1e-9) and r["rse"] >= math.sqrt(sse / 150)
    assert M.sigmoid_fits(df.limit(0), ["g"], "x", "y").collect() == []


def test_gee_of_independent_rows_is_the_logit_model(df):
    out = {r["term"]: r["coefficient"] for r in M.gee(df, "binary", ["a", "b"], "who", correlation="independence").collect()}
    kept = df.dropna(subset=["binary", "a", "b", "who"])
    both = kept.withColumn("fold", F.lit(0)).unionByName(kept.limit(1).withColumn("fold", F.lit(1)))  # fold 1 is fitted on all rows but one copy
    one = S.logit_exposure_response(both, "binary", ["a", "b"], "fold").filter("fold = 1").first()
    eta = out["(intercept)"] + out["a"] * one["a"] + out["b"] * one["b"]
    assert one["p"] == pytest.approx(1 / (1 + math.exp(-eta)), abs=1e-5)


def plain_reml(x, y, who, ratio):
    x = np.column_stack([np.ones(len(y)), x])
    v = np.eye(len(y)) + ratio * (who[:, None] == who[None, :])
    i = np.linalg.inv(v)
    h = x.T @ i @ x
    beta = np.linalg.solve(h, x.T @ i @ y)
    left = y - x @ beta
    s2 = left @ i @ left / (len(y) - x.shape[1])
    return -0.5 * ((len(y) - x.shape[1]) * math.log(s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(h)[1]), beta, s2, np.sqrt(np.diag(np.linalg.inv(h)) * s2), left


def test_random_intercepts_equal_whole_matrices(df, rows):
    model = M.RandomIntercept(df, "y", ["a", "b"], "who")
    x, y, who = np.array([r[4:6] for r in rows]), np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
    like, beta, s2, se, left = plain_reml(x, y, who, model.ratio)
    assert model.likelihood == pytest.approx(like, abs=1e-6)
    assert like >= max(plain_reml(x, y, who, model.ratio * t)[0] for t in (0.9, 0.99, 1.01, 1.1, 0.0)) - 1e-9
    out = model.coefficients().collect()
    assert [r["coefficient"] for r in out] == pytest.approx(list(beta), abs=1e-8) and [r["se"] for r in out] == pytest.approx(list(se), rel=1e-6)
    assert out[0]["residual_variance"] == pytest.approx(s2) and out[0]["intercept_variance"] == pytest.approx(model.ratio * s2)
    got = {r["who"]: r["intercept"] for r in model.intercepts().collect()}
    for w in np.unique(who):
        n = (who == w).sum()
        assert got[w] == pytest.approx(model.ratio * left[who == w].sum() / (1 + n * model.ratio), abs=1e-8)


def test_models_without_rows(df):
    none = df.limit(0)
    assert M.elastic_net_selection(none, "y", ["a"], "who", "fold").collect() == [] and M.gee(none, "y", ["a"], "who").collect() == []
    model = M.RandomIntercept(none, "y", ["a"], "who")
    assert model.coefficients().collect() == [] and model.intercepts().collect() == []
    assert M.elastic_net_selection(df.filter("fold = 1"), "y", ["a"], "who", "fold").collect() == []
