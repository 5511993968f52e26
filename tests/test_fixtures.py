"""Operators on tiny inputs with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonora.functions import acoustics as A
from sonora.functions import numeric as N
from sonora.operators import bands as B
from sonora.operators import levels as L
from sonora.operators import responses as R
from sonora.operators import sequences as Q
from sonora.operators import specific as S
from sonora.operators import stats as T
from sonora.sources import files


def signal(spark, values, recording=1, channel=0):
    return spark.createDataFrame([(recording, channel, i, float(v)) for i, v in enumerate(values)], "recording int, channel int, sample_idx long, p double")


def test_tone_level(spark):
    tone = 0.1 * np.sin(2 * np.pi * np.arange(800) / 8)
    row = L.level_stats(signal(spark, tone), 8.0).first()
    assert row["leq"] == pytest.approx(20 * math.log10(0.1 / math.sqrt(2) / 2e-5), abs=1e-9)
    assert row["le"] == pytest.approx(row["leq"] + 20)


def test_constant_signal(spark):
    s = signal(spark, [0.02] * 80)
    row = L.level_stats(s, 8.0).first()
    assert {row[f"l{x}"] for x in L.EXCEEDED} == {60.0}
    assert {r["intermittency"] for r in L.intermittency_ratio(s, 8).collect()} == {0.0}


def test_block_options(spark):
    s = signal(spark, [1.0] * 16)
    assert L.block_leq(s, 8).count() == 2
    assert L.block_leq(s, 8, drop_last_exact=True).count() == 1
    assert L.block_leq(signal(spark, [1.0]), 8).count() == 0


def test_first_of_equal_runs(spark):
    s = signal(spark, [0, 1, 1, 0, 1, 1, 0])
    row = L.event_runs(s, F.col("p") > 0.5).first()
    assert (row["start"], row["end"], row["n"]) == (1, 2, 2)


def test_equal_ears_and_power_average(spark):
    spec = spark.createDataFrame([(1, c, t, b, 2.5) for c in (0, 1) for t in range(3) for b in range(4)], "recording int, channel int, t_idx int, band int, value double")
    assert {round(r["value"], 12) for r in S.binaural_combine(spec).collect()} == {2.5}
    assert spec.agg(S.power_average(F.col("value")).alias("v")).first()["v"] == pytest.approx(2.5)
    low = S.tonality_average(S.tonality_curve(spec.withColumn("value", F.lit(0.01)))).first()
    assert low["mean_max"] is None and low["n_steps"] == 0


def test_circumplex(spark):
    points = [(1.0, 0.0, 1.0), (0.0, 0.0, 1.0), (math.cos(math.pi / 4), math.sin(math.pi / 4), 1.0), (math.cos(math.pi / 8), math.sin(math.pi / 8), 1 / math.cos(math.pi / 8))]
    x, y = A.iso_circumplex(F.col("x"), F.col("y"))
    for r in spark.createDataFrame(points, "x double, y double, s double").select("x", "y", "s", x.alias("ox"), y.alias("oy")).collect():
        assert r["ox"] == pytest.approx(r["x"] * r["s"]) and r["oy"] == pytest.approx(r["y"] * r["s"])


def test_sharpness_weight_edge(spark):
    assert spark.range(1).select(A.sharpness_weight(F.lit(10.0), F.lit(1.75)).alias("w")).first()["w"] == 0


def test_phon_anchor(spark):
    df = spark.createDataFrame([(40.0,), (41.0,), (-10.0,)], "phon double")
    out = {r["phon"]: r["sone"] for r in B.phon_to_sone(df, "phon").collect()}
    assert out[40.0] == pytest.approx(0.99999965, abs=1e-8)
    assert out[-10.0] < 0
    zero = spark.createDataFrame([(0.0,)], "sone double")
    assert B.sone_to_phon(zero, "sone").first()["phon"] == -math.inf


def test_change_rules(spark):
    rows = [(1, "A", 1, 9.0), (1, "A", 2, 10.0), (2, "A", 2, 3.0), (3, "A", 1, 1.0), (3, "A", 2, 8.0)]
    df = spark.createDataFrame(rows, "participant int, ambient string, lvl int, rating double")
    base = F.col("lvl") == 1
    out = {(r["participant"], r["lvl"]): r for r in R.change_to_highly_annoyed(R.change_from_baseline(df, ["participant", "ambient"], base, ["rating"]), ["participant", "ambient"], base).collect()}
    assert out[2, 2]["d_rating"] is None
    assert out[1, 1]["d_rating"] == 0 and out[1, 2]["d_rating"] == 1
    assert out[1, 2]["d_ha"] is None and out[3, 2]["d_ha"] == 1
    assert out[3, 1]["d_p_ha"] == 0


def test_duplicates_stop_the_wide_table(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0)], "id int, k string, v double")
    with pytest.raises(Exception, match="duplicate"):
        R.to_wide(df, "id", "k", "v", ["a"]).collect()


def test_last_rule_wins(spark):
    df = spark.createDataFrame([("BusyStreet6Quiet",), ("Park",)], "s string")
    out = [r["label"] for r in R.classify_by_substring(df, "s", [("BusyStreet6", "busy"), ("Quiet", "quiet")]).collect()]
    assert out == ["quiet", None]


def test_icc_of_identical_raters(spark):
    df = spark.createDataFrame([(s, r, float(s)) for s in range(5) for r in range(3)], "s int, r int, y double")
    assert T.icc_consistency(df, "s", "r", "y").first()["icc"] == pytest.approx(1)


def test_calibrated_predictions_have_slope_one(spark):
    rows = [(float(i < round(100 * p)), p) for p in (0.1, 0.3, 0.5, 0.8) for i in range(100)]
    row = T.calibration(spark.createDataFrame(rows, "y double, mu double"), "y", "mu").first()
    assert row["slope"] == pytest.approx(1, abs=1e-6) and row["intercept"] == pytest.approx(0, abs=1e-6)


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 1.0, 2.0], list(np.random.default_rng(6).exponential(size=3000)), [5.0] * 400 + [float(i) for i in range(100)]])
def test_mean_ranks(spark, values):
    import pandas as pd

    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = sorted((r["v"], r["rank"]) for r in T.mean_ranks(df, "v", "rank").collect() if r["v"] is not None)
    want = sorted(zip(values, pd.Series(values, dtype=float).rank(), strict=True))
    assert got == [(float(a), b) for a, b in want]


def test_binary_group_interval(spark):
    df = spark.createDataFrame([("a", 0.0)] * 5 + [("b", 1.0)] * 5 + [("c", float(i)) for i in range(9)], "k string, v double")
    out = {r["k"]: (r["low"], r["high"]) for r in Q.bootstrap_ci(df, ["k"], "v", "mean", 500).collect()}
    assert out["a"] == (0, 0) and out["b"] == (1, 1)
    assert 1 < out["c"][0] < 4 < out["c"][1] < 7
    assert Q.bootstrap_ci(df.repartition(7), ["k"], "v", "mean", 500).orderBy("k").collect() == Q.bootstrap_ci(df, ["k"], "v", "mean", 500).orderBy("k").collect()


def test_distributions():
    assert N.t_cdf(2.228138852, 10) == pytest.approx(0.975, abs=1e-6)
    assert N.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert N.beta_cdf(0.3, 2, 5) == pytest.approx(0.579825, abs=1e-6)
    v = np.arange(1.0, 12.0)
    assert N.harrell_davis(v, np.ones(11, int), 0.5) == pytest.approx(6)
    edges = [N.beta_cdf(i / 6, 7 * 0.25, 7 * 0.75) for i in range(7)]
    assert N.harrell_davis(np.array([1.0, 2.0, 5.0]), np.array([3, 1, 2]), 0.25) == pytest.approx(np.diff(edges) @ np.array([1, 1, 1, 2, 5, 5.0]))
    for values, counts in (([1.0, 4.0], [3, 3]), ([1.0, 2.0, 9.0], [1, 1, 5]), ([3.0], [4])):
        assert N.weighted_median(np.array(values), np.array(counts)) == np.median(np.repeat(values, counts))


def uneven(t, x, tau):
    out, y = [], x[0]
    for i, v in enumerate(x):
        k = 0.0 if i == 0 else math.exp(-(t[i] - t[i - 1]) / tau)
        y = (1 - k) * v + k * y
        out.append(y)
    return out


def test_uneven_average_matches_a_loop():
    rng = np.random.default_rng(1)
    for scale in (0.01, 1.0, 300.0):
        t, x = np.cumsum(rng.exponential(scale, 2000)), rng.random(2000)
        assert np.allclose(N.uneven_average(t, x, 1.0, math.nan, -math.inf), uneven(t, x, 1.0))
        head = N.uneven_average(t[:700], x[:700], 1.0, math.nan, -math.inf)
        assert np.allclose(N.uneven_average(t[700:], x[700:], 1.0, head[-1], t[699]), uneven(t, x, 1.0)[700:])
    assert len(N.uneven_average(np.zeros(0), np.zeros(0), 1.0, math.nan, -math.inf)) == 0


@pytest.mark.parametrize("scale", [0.2, 40.0, 900.0])
def test_batch_time_weight_over_spans(spark, scale):
    from sonora.streaming import monitor

    rng = np.random.default_rng(2)
    t, p = np.cumsum(rng.exponential(scale, 400)), rng.standard_normal(400)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, p, strict=True)] + [(2, 5.0, 0.02)], "recording int, t double, p double")
    got = monitor.batch_time_weight(df, 1.0).orderBy("recording", "t").toPandas()["level"].to_numpy()
    assert np.allclose(got[:-1], 10 * np.log10(np.maximum(uneven(t, p**2, 1.0), 1e-30) / 4e-10)) and got[-1] == pytest.approx(60)


def test_recursive_filter_matches_a_loop():
    rng = np.random.default_rng(7)
    x = rng.standard_normal(500)
    for b, a in ((np.array([0.2, 0.1]), np.array([1.0, -0.7])), N.third_order_lowpass(187.5), N.a_weight_coefficients(500.0)):
        y = []
        for i in range(len(x)):
            y.append(sum(b[k] * x[i - k] for k in range(len(b)) if i >= k) - sum(a[k] * y[i - k] for k in range(1, len(a)) if i >= k))
        assert np.allclose(N.recursive_filter(b, a, x, False), y, atol=1e-8)
        assert len(N.recursive_filter(b, a, x[:1], True)) == 1


@pytest.mark.parametrize("chunk", [1, 7, 64, 10_000])
@pytest.mark.parametrize("offset", [0, 5, 1000])
def test_time_weight_of_trimmed_recordings(spark, chunk, offset):
    x = np.random.default_rng(2).standard_normal(150)
    rows = signal(spark, x).withColumn("sample_idx", F.col("sample_idx") + offset)
    want = Q.time_weight(signal(spark, x), 8.0, 0.7).orderBy("sample_idx").toPandas()["weighted"]
    got = Q.time_weight(rows, 8.0, 0.7, chunk=chunk).orderBy("sample_idx").toPandas()["weighted"]
    assert np.allclose(got, want)
    ones = Q.time_weight(rows.withColumn("p", F.lit(1.0)), 8.0, 0.7, chunk=chunk)
    assert ones.filter("abs(weighted - 1) > 1e-9").count() == 0


def test_asymmetric_lowpass_does_not_depend_on_chunks(spark):
    rng = np.random.default_rng(8)
    spec = spark.createDataFrame([(1, 0, t, b, float(rng.random())) for t in range(400) for b in range(2)], "recording int, channel int, t_idx int, band int, value double")
    whole = Q.asymmetric_lowpass(spec, 4.0).orderBy("t_idx", "band").toPandas()["smoothed"]
    parts = Q.asymmetric_lowpass(spec, 4.0, chunk=150).orderBy("t_idx", "band").toPandas()["smoothed"]
    assert np.allclose(whole, parts, atol=1e-12)


def test_impulsive_loudness_in_chunks(spark):
    rng = np.random.default_rng(9)
    steps = [t for t in range(200) if t % 17]
    v = dict(zip(steps, rng.random(len(steps)).tolist(), strict=True))
    curve = spark.createDataFrame([(1, 0, t, x) for t, x in v.items()], "recording int, channel int, t_idx int, value double")
    for chunk in (30, 1000):
        for r in S.impulsive_loudness(curve, 6, 20.0, chunk=chunk).collect():
            near = [x for t, x in v.items() if abs(t - r["t_idx"]) <= 6]
            assert r["base"] == pytest.approx(np.quantile(near, 0.2)) and r["impulse"] == pytest.approx(max(0, v[r["t_idx"]] - r["base"]))


def test_negative_roughness_counts_as_zero(spark):
    spec = spark.createDataFrame([(1, 0, 0, b, x) for b, x in enumerate([-0.5, 0.0, 0.4, 0.8])], "recording int, channel int, t_idx int, band int, value double")
    out = [r["value"] for r in S.roughness_transform(spec).orderBy("band").collect()]
    assert out[:2] == [0.0, 0.0] and all(x > 0 for x in out[2:])


def test_aligned_curves(spark):
    fine = spark.createDataFrame([(1, 0, t / 4, float(t)) for t in range(9)], "recording int, channel int, t double, value double")
    coarse = spark.createDataFrame([(1, 0, 0.5, 1.0), (1, 0, 1.5, 3.0)], "recording int, channel int, t double, value double")
    out = Q.align_curves({"a": fine, "b": coarse}, "a").orderBy("t").collect()
    assert [r["a"] for r in out] == [float(t) for t in range(9)]
    assert [r["b"] for r in out] == [None, None, 1.0, 1.5, 2.0, 2.5, 3.0, None, None]


def test_ids_in_name_order(spark):
    names = [f"s{(i * 37) % 5000:04d}" for i in range(5000)]
    out = R.assign_ids(spark.createDataFrame([(n,) for n in names], "k string"), "k").collect()
    assert {r["k"]: r["stim_id"] for r in out} == {n: i for i, n in enumerate(sorted(names), 1)}
    assert R.assign_ids(spark.createDataFrame([], "k string"), "k").count() == 0


def test_missing_pairs_in_lots(spark, monkeypatch):
    monkeypatch.setattr(R, "LOT", 2)
    rows = [(p, f"s{k}") for p in range(4) for k in range(7) if (p + k) % 3] + [(9, None)]
    got = {tuple(r) for r in R.missing_pairs(spark.createDataFrame(rows, "participant int, stimulus string")).collect()}
    assert got == {(p, f"s{k}") for p in (0, 1, 2, 3, 9) for k in range(7)} - set(rows)


def test_first_row_of_a_participant(spark):
    df = spark.createDataFrame([(1, 2, "a"), (1, 1, "z"), (2, None, "q")], "who int, x int, y string")
    assert sorted(map(tuple, R.first_per_participant(df, "who", ["x", "y"]).collect())) == [(1, 1, "z"), (2, None, "q")]


@pytest.mark.parametrize("chunk", [7, 64, 10_000])
def test_time_weight_does_not_depend_on_chunks(spark, chunk):
    x = np.random.default_rng(2).standard_normal(300)
    k, y, want = math.exp(-1 / 8), x[0] ** 2, []
    for v in x:
        y = (1 - k) * v * v + k * y
        want.append(math.sqrt(y))
    got = [r["weighted"] for r in Q.time_weight(signal(spark, x), 8.0, 1.0, chunk=chunk).orderBy("sample_idx").collect()]
    assert np.allclose(got, want)


def test_a_weighting_gain():
    b, a = N.a_weight_coefficients(48_000.0)
    gain = lambda f: 20 * math.log10(abs(np.polyval(b, z := np.exp(2j * math.pi * f / 48_000)) / np.polyval(a, z)))
    assert gain(1000) == pytest.approx(0, abs=0.05)
    assert gain(100) == pytest.approx(-19.1, abs=0.2)
    assert gain(31.62) == pytest.approx(-39.4, abs=0.3)


def test_filters_do_not_depend_on_chunks(spark):
    x = np.random.default_rng(3).standard_normal(4000)
    whole = Q.a_weight_time(signal(spark, x), 500.0).orderBy("sample_idx").toPandas()["weighted"]
    parts = Q.a_weight_time(signal(spark, x), 500.0, chunk=1500).orderBy("sample_idx").toPandas()["weighted"]
    assert np.allclose(whole, parts, atol=1e-6)


def test_autospectrum_of_a_tone(spark):
    tone = np.sin(2 * np.pi * 2 * np.arange(256) / 16)
    out = Q.autospectrum(signal(spark, tone), 16.0, 64).toPandas().set_index("freq")
    assert out["rms"].idxmax() == 2.0
    assert out.loc[2.0, "rms"] == pytest.approx(1 / math.sqrt(2))
    assert out.loc[2.0, "peak"] == pytest.approx(1)


def test_spec_matrix_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_text("NaN\t0.5\t1.0\n0.0\t1.5\t2.5\n0.1\t3.5\t4.5\n")
    rows = files.read_spec_matrix(spark, str(tmp_path)).orderBy("t", "band").collect()
    assert [(r["t"], r["band"], r["value"]) for r in rows] == [(0.0, 0.5, 1.5), (0.0, 1.0, 2.5), (0.1, 0.5, 3.5), (0.1, 1.0, 4.5)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5), (2, "b", None)], "id int, k string, v double")
    files.write_tables(df, str(tmp_path / "t"), "csv")
    back = files.read_response_csvs(spark, str(tmp_path / "t"), df.schema)
    assert sorted(map(tuple, back.drop("source_file").collect())) == [(1, "a", 2.5), (2, "b", None)]


def test_late_rows_stay_out_of_closed_blocks(spark, tmp_path):
    from datetime import datetime

    from sonora.streaming import monitor

    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    schema = "ts timestamp, recording int, p double"
    for i, rows in enumerate(([(at(0, 10), 1, 0.02)], [(at(9), 1, 0.02)], [(at(0, 20), 1, 2.0), (at(12), 1, 0.02)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = monitor.stream_block_leq(stream, "1 hour", "1 hour")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        assert i >= 0
    first = spark.read.parquet(str(tmp_path / "out")).filter("hour(block_start) = 0").collect()
    assert [(r["n"], round(r["leq"], 6)) for r in first] == [(1, 60.0)]
