"""Queries and operators do the whole job: brute force over all rows, frames, channels and cells."""

import numpy as np
import pandas as pd
import pytest
from sqlcheck import connection

from sonora import plans
from sonora.plans import statistics as P


def logit_fit(x, y):
    x, b = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    return b


def test_logit_predicts_every_row_of_every_fold(spark, sf_dir):
    rows = connection(sf_dir).sql(P._PRED).df()
    got = plans.all_queries()["logit_exposure_response"](spark, sf_dir).toPandas()
    assert len(got) == len(rows) and got["p"].notna().all() and set(got["fold"]) == set(range(6))
    x, y, fold = rows[["mu", "tax"]].to_numpy(dtype=float), rows["y"].to_numpy(dtype=float), rows["fold"].to_numpy()
    p = np.empty(len(rows))
    for f in range(6):
        b = logit_fit(x[fold != f], y[fold != f])
        p[fold == f] = 1 / (1 + np.exp(-(b[0] + x[fold == f] @ b[1:])))
    rows["p"] = p
    order = ["l_orderkey", "fold", "y", "p"]
    a, b = got[order].sort_values(order), rows[order].sort_values(order)
    assert (a[order[:3]].to_numpy() == b[order[:3]].to_numpy()).all()
    assert a["p"].to_numpy() == pytest.approx(b["p"].to_numpy(), abs=2e-6)


@pytest.mark.parametrize("name", ["bins_to_bands_frames", "psych_annoyance_curve_channels"])
def test_all_frames_and_channels(spark, sf_dir, name):
    from sonora.sources import adapters as D

    got, keys = plans.all_queries()[name](spark, sf_dir), ["recording", "channel", "t_idx"]
    assert {tuple(r) for r in got.select(keys).collect()} == {tuple(r) for r in D.spec_metric(spark, sf_dir).select(keys).collect()}


def test_bands_of_all_frames_sum_the_frames(spark, sf_dir):
    frames = plans.all_queries()["bins_to_bands_frames"](spark, sf_dir).toPandas()
    frames["energy"] = 10 ** (frames["level_db"] / 10)
    want = 10 * np.log10(frames.groupby(["recording", "channel", "band"])["energy"].sum())
    got = plans.all_queries()["bins_to_bands"](spark, sf_dir).toPandas().set_index(["recording", "channel", "band"])["level_db"]
    assert np.allclose(got.sort_index(), want.sort_index(), atol=1e-4)


def test_principal_components_match_eigenvectors(spark, sf_dir):
    cols = ["l_quantity", "l_extendedprice", "l_tax", "l_discount"]
    x = connection(sf_dir).sql(f"SELECT {', '.join(cols)} FROM lineitem").df().to_numpy(float)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    vectors = np.linalg.eigh(np.cov(z.T))[1][:, ::-1][:, :2]
    want = z @ (vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(2)]))
    got = plans.all_queries()["principal_components"](spark, sf_dir).select("pc1", "pc2").toPandas().to_numpy()
    assert np.allclose(np.sort(got, axis=0), np.sort(want, axis=0), atol=1e-5)


def test_calibration_matches_newton_steps(spark, sf_dir):
    rows = connection(sf_dir).sql(P._PRED).df()
    p = rows["mu"].clip(1e-6, 1 - 1e-6).to_numpy(float)
    want = logit_fit(np.log(p / (1 - p))[:, None], rows["y"].to_numpy(float))
    got = plans.all_queries()["calibration"](spark, sf_dir).first()
    assert (got["intercept"], got["slope"]) == pytest.approx(tuple(want), abs=1e-5)


def test_probit_scores(spark, sf_dir):
    import math

    from sonora.sources import adapters as D

    rating = {(r["participant"], r["ambient"], r["lvl"]): r["rating"] for r in D.ratings(spark, sf_dir).collect()}
    for r in plans.all_queries()["score_probit"](spark, sf_dir).collect():
        eta = -1 + 0.1 * rating[r["participant"], r["ambient"], r["lvl"]]
        assert r["mu"] == pytest.approx(0.5 * math.erfc(-eta / math.sqrt(2)), abs=1e-6)


def test_a_weighting_matches_a_loop(spark, sf_dir):
    from sonora.functions import numeric as N
    from sonora.sources import adapters as D

    b, a = N.a_weight_coefficients(float(D.RATE))
    signals = D.signals(spark, sf_dir).toPandas()
    got = plans.all_queries()["a_weight_time"](spark, sf_dir).toPandas().set_index(["recording", "channel", "sample_idx"])["weighted"]
    for (recording, channel), own in list(signals.groupby(["recording", "channel"]))[:20]:
        x = own.sort_values("sample_idx")["p"].to_numpy()
        y, at, level = [], np.full(len(b) - 1, x[0]), b.sum() / a.sum() * x[0]
        past = np.full(len(a) - 1, level)
        for v in x:
            y.append((b[0] * v + b[1:] @ at - a[1:] @ past) / a[0])
            at, past = np.append(v, at[:-1]), np.append(y[-1], past[:-1])
        assert np.allclose(got.loc[recording, channel].sort_index(), y, atol=1e-6)


def test_permutations_match_all_sign_flips(spark):
    import itertools

    from sonora.operators import sequences as Q

    d = [1.0, 2.0, 2.0, -1.0, 3.0, 0.5, 2.0, 1.0]
    want = np.mean([abs(np.mean(np.multiply(s, d))) >= abs(np.mean(d)) - 1e-12 for s in itertools.product([-1, 1], repeat=len(d))])
    df = spark.createDataFrame([("k", x, 0.0) for x in d], "k string, a double, b double")
    assert Q.permutation_test(df, ["k"], "a", "b").first()["p_value"] == pytest.approx(want, abs=0.01)


def test_bootstrap_matches_plain_draws(spark):
    from sonora.operators import sequences as Q

    rng = np.random.default_rng(5)
    v = np.round(rng.gamma(2.0, 2.0, 200))
    df = spark.createDataFrame([("k", float(x)) for x in v], "k string, v double")
    draws = v[rng.integers(0, len(v), (20_000, len(v)))]
    for statistic, plain in (("median", np.median(draws, axis=1)), ("mean", draws.mean(axis=1))):
        r = Q.bootstrap_ci(df, ["k"], "v", statistic).first()
        assert (r["low"], r["high"]) == pytest.approx(tuple(np.quantile(plain, [0.025, 0.975])), abs=0.15)


def test_partial_correlations_match_residuals(spark):
    from sonora.operators import stats as T

    rng = np.random.default_rng(6)
    z = rng.standard_normal((300, 3))
    x, y = z @ [1, 0.5, 0] + rng.standard_normal(300), z @ [0, 1, 1] + rng.standard_normal(300)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "u": z[:, 0], "v": z[:, 1], "w": z[:, 2]}))
    rank = lambda a: pd.Series(a).rank().to_numpy()
    c = np.column_stack([np.ones(300), *[rank(z[:, i]) for i in range(3)]])
    residual = lambda a: rank(a) - c @ np.linalg.lstsq(c, rank(a), rcond=None)[0]
    semi, both = (T.partial_correlations(df, ["x"], ["y"], ["u", "v", "w"], s).first()["r"] for s in (True, False))
    assert semi == pytest.approx(np.corrcoef(residual(x), rank(y))[0, 1]) and both == pytest.approx(np.corrcoef(residual(x), residual(y))[0, 1])
    assert T.partial_correlations(df, ["x"], ["y"], []).first()["r"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])


def tau_b(x, y):
    sx, sy = np.sign(np.subtract.outer(x, x)), np.sign(np.subtract.outer(y, y))
    return (sx * sy).sum() / np.sqrt((sx != 0).sum() * float((sy != 0).sum()))


def test_kendall_of_many_cells(spark, sf_dir):
    rows = connection(sf_dir).sql("SELECT l_quantity, l_extendedprice, l_tax FROM lineitem").df().astype(float)
    got = {(r["a"], r["b"]): r for r in plans.all_queries()["correlation_kendall_columns"](spark, sf_dir).collect()}
    assert len(got) == 3
    for (a, b), r in got.items():
        assert r["n"] == len(rows) and r["r"] == pytest.approx(tau_b(rows[a].to_numpy(), rows[b].to_numpy()), abs=1e-6)


def test_kendall_beyond_the_old_cap(spark):
    from sonora.operators import stats as T

    rng = np.random.default_rng(4)
    x = rng.random(21_000)
    y = np.round(x + rng.random(21_000), 4)
    order = np.argsort(x)
    v, s = y[order], 0
    for i in range(len(v)):
        s += int(np.sign(v[i + 1 :] - v[i]).sum())
    n, ties = len(x) * (len(x) - 1) / 2, np.unique(y, return_counts=True)[1]
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    got = T.kendall(df, "x", "y").first()["r"]
    assert got == pytest.approx(s / np.sqrt(n * (n - (ties * (ties - 1) / 2).sum())), abs=1e-12)
