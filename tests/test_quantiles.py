"""Quantiles, running counts and Harrell-Davis quartiles by ranges, against numpy, on continuous, tied, missing and large groups."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonora.functions import numeric as N
from sonora.operators import responses as R
from sonora.operators import sequences as Q
from sonora.operators import stats as S


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(21)
    rows = [("large", float(v)) for v in rng.normal(size=9000)] + [("ties", float(v)) for v in rng.integers(0, 4, 700)] + [("one", 5.0), (None, 1.0), (None, 2.0), ("nothing", None), ("large", None)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(4)


@pytest.mark.parametrize("per_range", [10**6, 500])
def test_quantiles_equal_numpy(groups, monkeypatch, per_range):
    monkeypatch.setattr(S, "PER_RANGE", per_range)
    rows, df = groups
    shares = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r["q"] for r in S.exact_quantiles(df, ["g"], "v", shares, "q").collect()}
    values = {}
    for g, v in rows:
        if v is not None:
            values.setdefault(g, []).append(v)
    assert got.keys() == values.keys()
    for g, own in values.items():
        assert got[g] == pytest.approx(np.quantile(own, shares).tolist(), abs=1e-12)
    every = S.exact_quantiles(df, [], "v", shares).first()["quantiles"]
    assert every == pytest.approx(np.quantile([v for _, v in rows if v is not None], shares).tolist(), abs=1e-12)
    assert S.exact_quantiles(df.limit(0), [], "v", [0.5]).first()["quantiles"] == [None] and S.exact_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_ranges_follow_the_values(groups, monkeypatch):
    _, df = groups
    counts = df.dropna().groupBy("v").agg(F.count("*").alias("n"))
    assert len(S._cuts(counts, "v")) == 8  # a range for each thousand values
    monkeypatch.setattr(S, "PER_RANGE", 5)
    monkeypatch.setattr(S, "FINE", 256)
    cuts = S._cuts(counts, "v")
    assert 1000 < len(cuts) < 2000
    out = S.running_counts(counts, "v", "n", "below").orderBy("v").collect()
    assert [r["below"] for r in out] == [0, *np.cumsum([r["n"] for r in out])[:-1]]


def test_harrell_davis_of_large_groups(groups):
    rows, df = groups
    got = {r["g"]: (r["q1"], r["q3"]) for r in Q.harrell_davis_quartiles(df, "g", "v").collect()}
    for g in ("large", "ties", "one"):
        values, counts = np.unique([v for k, v in rows if k == g and v is not None], return_counts=True)
        assert got[g] == pytest.approx([N.harrell_davis(values, counts, q) for q in (0.25, 0.75)], abs=1e-8)


def test_beta_of_arrays():
    rng = np.random.default_rng(4)
    x, a, b = rng.random(300), rng.random(300) * 40 + 0.5, rng.random(300) * 40 + 0.5
    assert N.beta_cdfs(x, a, b) == pytest.approx([N.beta_cdf(*p) for p in zip(x, a, b, strict=True)], abs=1e-11)
    assert N.beta_cdfs(np.array([0.0, 1.0, 0.25, 0.2, 0.3]), np.array(2.5e6), np.array(7.5e6)) == pytest.approx([0, 1, 0.5, 0, 1], abs=1e-3)


def test_median_of_what_is_missing(spark):
    df = spark.createDataFrame([(1, 3.0), (2, None), (3, 9.0), (4, 4.0)], "i long, x double")
    assert {r["i"]: (r["x"], r["x_missing"]) for r in R.impute_median(df, "x").collect()} == {1: (3.0, False), 2: (4.0, True), 3: (9.0, False), 4: (4.0, False)}
    assert R.impute_median(df.filter("x IS NULL"), "x").first()["x"] is None
