"""Curves at other times, linear and on the monotone cubic, in one range and in many, against plain loops."""

from __future__ import annotations

import numpy as np
import pytest

from sonora.operators import sequences as Q


def plain_slopes(t, v):
    n = len(t)
    if n == 1:
        return [0.0]
    h, d = np.diff(t), np.diff(v) / np.diff(t)
    if n == 2:
        return [d[0], d[0]]

    def end(h0, h1, d0, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if np.sign(s) != np.sign(d0):
            return 0.0
        return 3 * d0 if np.sign(d0) != np.sign(d1) and abs(s) > 3 * abs(d0) else s

    out = [end(h[0], h[1], d[0], d[1])]
    for k in range(1, n - 1):
        w0, w1 = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
        out.append(0.0 if d[k - 1] * d[k] <= 0 else (w0 + w1) / (w0 / d[k - 1] + w1 / d[k]))
    return [*out, end(h[-1], h[-2], d[-1], d[-2])]


def plain(t, v, at, cubic):
    if at in t:
        return v[t.index(at)]
    if at < t[0] or at > t[-1]:
        return None
    k = np.searchsorted(t, at) - 1
    h = t[k + 1] - t[k]
    s = (at - t[k]) / h
    if not cubic:
        return v[k] + (v[k + 1] - v[k]) * s
    m = plain_slopes(t, v)
    return v[k] * (1 + 2 * s) * (1 - s) ** 2 + h * m[k] * s * (1 - s) ** 2 + v[k + 1] * s * s * (3 - 2 * s) + h * m[k + 1] * s * s * (s - 1)


@pytest.fixture(scope="module")
def curves(spark):
    rng = np.random.default_rng(9)
    out = {}
    for key, n in (("long", 90), ("short", 3), ("two", 2), ("one", 1), (None, 20)):
        t = np.unique(np.round(rng.uniform(0, 50, n), 2))
        out[key] = t.tolist(), np.round(rng.normal(size=len(t)).cumsum(), 1).tolist()
    rows = [(k, 0, a, b) for k, (t, v) in out.items() for a, b in zip(t, v, strict=True)] + [("long", 0, 1.0, None), ("short", 0, None, 2.0)]
    asked = [(k, 0, float(a)) for k, (t, _) in out.items() for a in [*t[:5], *np.round(rng.uniform(-3, 53, 60), 3)]] + [("nobody", 0, 1.0)]
    kinds = "recording string, channel int, t double"
    return out, spark.createDataFrame(rows, f"{kinds}, value double").repartition(3), spark.createDataFrame(asked, kinds), asked


@pytest.mark.parametrize("cubic", [False, True])
@pytest.mark.parametrize("ranges", [None, 25])
def test_resampling_equals_plain_loops(curves, cubic, ranges):
    out, curve, grid, asked = curves
    got = sorted(((r["recording"], r["t"], r["value"]) for r in Q.resample(curve, grid, cubic=cubic, ranges=ranges).collect()), key=str)
    want = sorted(((k, a, plain(*out[k], a, cubic) if k in out else None) for k, _, a in asked), key=lambda x: str((x[0], x[1], 0)))
    assert [g[:2] for g in sorted(got, key=lambda x: str((x[0], x[1], 0)))] == [w[:2] for w in want]
    for g, w in zip(sorted(got, key=lambda x: str((x[0], x[1], 0))), want, strict=True):
        assert g[2] == (w[2] if w[2] is None else pytest.approx(w[2], abs=1e-9))


def test_samples_of_one_time_are_averaged(spark, curves):
    curve = spark.createDataFrame([("a", 0, 0.0, 1.0), ("a", 0, 0.0, 3.0), ("a", 0, 2.0, 6.0)], "recording string, channel int, t double, value double")
    grid = spark.createDataFrame([("a", 0, 0.0), ("a", 0, 1.0), ("a", 0, 1.0)], "recording string, channel int, t double")
    assert sorted(r["value"] for r in Q.resample(curve, grid).collect()) == [2.0, 4.0, 4.0]
    assert Q.resample(curve.limit(0), grid).filter("value IS NOT NULL").count() == 0 and Q.resample(curve, grid.limit(0)).count() == 0
