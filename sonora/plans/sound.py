"""Queries on signals, band values and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import acoustics as A
from ..operators import bands as B
from ..operators import levels as L
from ..operators import responses as R
from ..operators import sequences as Q
from ..operators import specific as S
from ..runtime import shared_folder
from ..sources import adapters as D
from ..sources import files
from .registry import plan

CURVE = "SELECT recording, channel, t_idx, sum(value) * 0.5e0 AS value FROM spec_metric GROUP BY ALL"


def curve(spark, d):
    return S.band_integrate(D.spec_metric(spark, d))


@plan("""
SELECT recording, channel, count(*) AS n, 10 * log10(avg(p * p) / 4e-10) AS leq, 10 * log10(avg(p * p) / 4e-10) + 10 * log10(count(*) / 8.0e0) AS le,
 max(lv) AS lmax, quantile_cont(lv, 0.95) AS l5, quantile_cont(lv, 0.90) AS l10, quantile_cont(lv, 0.75) AS l25, quantile_cont(lv, 0.5) AS l50,
 quantile_cont(lv, 0.25) AS l75, quantile_cont(lv, 0.1) AS l90, quantile_cont(lv, 0.05) AS l95
FROM (SELECT *, CASE WHEN p <> 0 THEN round(20 * log10(abs(p) / 2e-5), 2) END AS lv FROM signals) GROUP BY recording, channel""", "leq le lmax l5 l10 l25 l50 l75 l90 l95")
def level_stats(spark, d):
    return L.level_stats(D.signals(spark, d), D.RATE)


@plan("SELECT recording, max(leq) AS leq, max(lmax) AS lmax FROM (SELECT recording, channel, 10 * log10(avg(p * p) / 4e-10) AS leq, max(round(20 * log10(abs(p) / 2e-5), 2)) FILTER (p <> 0) AS lmax FROM signals GROUP BY ALL) GROUP BY recording", "leq lmax")
def max_over_channels(spark, d):
    return L.max_over_channels(L.level_stats(D.signals(spark, d), D.RATE), ["leq", "lmax"])


@plan("SELECT recording, channel, sample_idx // 8 AS block_idx, 10 * log10(avg(p * p) / 4e-10) AS leq FROM signals GROUP BY ALL HAVING count(*) = 8", "leq")
def block_leq(spark, d):
    return L.block_leq(D.signals(spark, d), D.RATE)


@plan("""
SELECT recording, c, max(ratio) AS intermittency FROM (
 SELECT w.recording, w.channel, c, coalesce(100 * sum(pow(10, leq / 10)) FILTER (leq > whole + c) / any_value(n / 8.0e0) / pow(10, any_value(whole) / 10), 0) AS ratio
 FROM (SELECT recording, channel, 10 * log10(avg(p * p) / 4e-10) AS whole, count(*) AS n FROM signals GROUP BY ALL) w
 CROSS JOIN (VALUES (2.0e0), (3.0e0), (5.0e0)) t(c)
 LEFT JOIN (SELECT recording, channel, sample_idx // 8 AS b, 10 * log10(avg(p * p) / 4e-10) AS leq FROM signals GROUP BY ALL HAVING count(*) = 8) s
   ON s.recording = w.recording AND s.channel = w.channel AND (b + 1) * 8 < n
 GROUP BY ALL) GROUP BY recording, c""", "c intermittency")
def intermittency_ratio(spark, d):
    return L.intermittency_ratio(D.signals(spark, d), D.RATE)


@plan("SELECT recording, channel, sample_idx, sample_idx / 8.0e0 AS t, p FROM (SELECT *, max(sample_idx / 8.0e0) OVER (PARTITION BY recording, channel) AS last FROM signals) WHERE sample_idx / 8.0e0 > 0.5 AND sample_idx / 8.0e0 < last - 0.5", "t p")
def skip_ends(spark, d):
    s = D.signals(spark, d).withColumn("t", F.col("sample_idx") / D.RATE)
    return L.skip_ends(s, ["recording", "channel"], "t", 0.5, 0.5).select("recording", "channel", "sample_idx", "t", "p")


@plan("""SELECT s.recording, s.channel, sample_idx - 8 AS sample_idx, p * pow(10, (70 - whole) / 20) AS p FROM signals s
JOIN (SELECT recording, channel, 10 * log10(avg(p * p) / 4e-10) AS whole FROM signals GROUP BY ALL) w ON w.recording = s.recording AND w.channel = s.channel
WHERE sample_idx >= 8 AND sample_idx < 40""", "p")
def calibrate_truncate(spark, d):
    return L.truncate(L.calibrate(D.signals(spark, d), "leq", 70.0, D.RATE), 8, 40).select("recording", "channel", "sample_idx", "p")


@plan("""
WITH f AS (SELECT recording, channel, sample_idx, sample_idx - row_number() OVER (PARTITION BY recording, channel ORDER BY sample_idx) AS g FROM signals WHERE p > 0.03),
r AS (SELECT recording, channel, min(sample_idx) AS start, max(sample_idx) AS "end", count(*) AS n FROM f GROUP BY recording, channel, g)
SELECT recording, channel, start, "end", n FROM (SELECT *, row_number() OVER (PARTITION BY recording, channel ORDER BY n DESC, start) AS k FROM r) WHERE k = 1""")
def event_runs_longest(spark, d):
    return L.event_runs(D.signals(spark, d), F.col("p") > 0.03)


@plan('SELECT recording, channel, min(sample_idx) AS start, max(sample_idx) AS "end" FROM signals WHERE p > 0.2 GROUP BY ALL')
def event_runs_ends(spark, d):
    return L.event_runs(D.signals(spark, d), F.col("p") > 0.2, mode="firstlast")


@plan("SELECT recording, channel, 10 * log10(sum(pow(10, level_db / 10))) AS total_db, 10 * log10(avg(pow(10, level_db / 10))) AS mean_db, max(2e-5 * pow(10, level_db / 20)) * 1000 AS top_mpa FROM thirds GROUP BY ALL", "total_db mean_db top_mpa")
def db_sum_mean(spark, d):
    return D.third_octaves(spark, d).groupBy("recording", "channel").agg(A.db_sum(F.col("level_db")).alias("total_db"), A.db_mean(F.col("level_db")).alias("mean_db"), (F.max(A.pressure_from_level(F.col("level_db"))) * 1000).alias("top_mpa"))


@plan("""SELECT recording, channel, t_idx, band, f, level_db + 20 * log10(12194.0e0 ** 2 * f ** 4 / ((f * f + 20.6e0 ** 2) * sqrt((f * f + 107.7e0 ** 2) * (f * f + 737.9e0 ** 2)) * (f * f + 12194.0e0 ** 2))) + 2 AS a_db,
 level_db + 20 * log10(12194.0e0 ** 2 * f ** 2 / ((f * f + 20.6e0 ** 2) * (f * f + 12194.0e0 ** 2))) + 0.061904281992313e0 AS c_db FROM (SELECT *, 1000 * pow(10, 0.3e0 * (band - 17) / 3) AS f FROM thirds)""", "f a_db c_db")
def weight_spectrum(spark, d):
    f = 1000 * F.pow(F.lit(10.0), 0.3 * (F.col("band") - 17) / 3)
    return D.third_octaves(spark, d).select("recording", "channel", "t_idx", "band", f.alias("f"), (F.col("level_db") + A.weighting_db(f)).alias("a_db"), (F.col("level_db") + A.weighting_db(f, "C")).alias("c_db"))


@plan("""SELECT event_id, asinh(0.1618e0 / 81.9289e0 * f) / 0.1618e0 AS sottek, 7 * asinh(f / 650) AS schroeder, 13 * atan(0.00076e0 * f) + 3.5e0 * atan(pow(f / 7500, 2)) AS zwicker,
 32.12e0 * (1 - pow(1 + pow(f / 873.47e0, 1.18e0), -0.4e0)) AS volk,
 CASE WHEN z < 2 THEN z + 0.15e0 * (2 - z) WHEN z > 20.1 THEN z + 0.22e0 * (z - 20.1e0) ELSE z END AS traunmueller, f AS back_sottek, f AS back_volk, f AS back_schroeder, f AS back_traunmueller
FROM (SELECT event_id, f, 26.81e0 * f / (1960 + f) - 0.53e0 AS z FROM (SELECT event_id, value * 40 AS f FROM events))""", "sottek schroeder zwicker volk traunmueller back_sottek back_volk back_schroeder back_traunmueller", digits=5)
def bark_scales(spark, d):
    f = F.col("value") * 40
    e = D.table(spark, d, "events").select("event_id", *[A.hertz_to_bark(f, m).alias(m) for m in ("sottek", "schroeder", "zwicker", "volk", "traunmueller")])
    return e.select("*", *[A.bark_to_hertz(F.col(m), m).alias(f"back_{m}") for m in ("sottek", "volk", "schroeder", "traunmueller")])


_C = B.C
_SEG = ", ".join(f"({'NULL::DOUBLE' if i == 0 else f'{float(a)!r}::DOUBLE'}, {'NULL::DOUBLE' if i == 66 else f'{float(b)!r}::DOUBLE'}, {float(a)!r}::DOUBLE, {float(ya)!r}::DOUBLE, {float((yb - ya) / (b - a))!r}::DOUBLE)" for i, (a, b, ya, yb) in enumerate(zip(_C.PHON, _C.PHON[1:], _C.SONE, _C.SONE[1:], strict=False)))


@plan(f"""SELECT event_id, phon, y + (phon - x) * s AS sone, phon AS back FROM (SELECT event_id, value / 4 - 4 AS phon FROM events)
JOIN (VALUES {_SEG}) t(lo, hi, x, y, s) ON (lo IS NULL OR phon >= lo) AND (hi IS NULL OR phon < hi)""", "phon sone back", digits=5)
def phon_sone(spark, d):
    e = D.table(spark, d, "events").select("event_id", (F.col("value") / 4 - 4).alias("phon"))
    return B.sone_to_phon(B.phon_to_sone(e, "phon"), "sone", "back")


@plan("""SELECT vec_id, band, phon, 10 / a * log10(pow(4e-10, 0.3e0 - a) * (pow(10, 0.03e0 * phon) - pow(10, 0.072e0)) + pow(10, a * (t + 0.5e0) / 10)) - 0.5e0 AS level_db
FROM (SELECT vec_id, band, 40 + 40 * e AS phon, 0.25e0 + 0.002e0 * band AS a, 30 - 0.5e0 * band AS t FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS e, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS band FROM embeddings) WHERE band < 29)""", "phon level_db")
def equal_loudness(spark, d):
    e = D.table(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 29)).alias("band", "e"))
    e = e.select("vec_id", "band", (40 + 40 * F.col("e").cast("double")).alias("phon"))
    return e.withColumn("level_db", A.equal_loudness_level(F.col("phon"), 0.25 + 0.002 * F.col("band"), F.lit(0.5), 30 - 0.5 * F.col("band")))


@plan(CURVE, "value")
def band_integrate(spark, d):
    return curve(spark, d)


@plan("SELECT recording, t_idx, band, sqrt(sum(value * value) / 2) AS value FROM spec_metric GROUP BY ALL HAVING count(*) = 2", "value")
def binaural_combine(spark, d):
    return S.binaural_combine(D.spec_metric(spark, d))


@plan(f"SELECT recording, channel, pow(avg(pow(value, 1 / log10(2))), log10(2)) AS power_average, avg(value) AS mean FROM ({CURVE}) GROUP BY ALL", "power_average mean")
def power_average(spark, d):
    return curve(spark, d).groupBy("recording", "channel").agg(S.power_average(F.col("value")).alias("power_average"), F.avg("value").alias("mean"))


@plan(f"SELECT recording, max(ex5) AS ex5, max(ex10) AS ex10, max(ex50) AS ex50 FROM (SELECT recording, channel, quantile_cont(value, 0.95) AS ex5, quantile_cont(value, 0.9) AS ex10, quantile_cont(value, 0.5) AS ex50 FROM ({CURVE}) GROUP BY ALL) GROUP BY recording", "ex5 ex10 ex50")
def percentile_exceeded(spark, d):
    return S.percentile_exceeded(curve(spark, d), [5, 10, 50])


_TON = "SELECT recording, channel, t_idx, max(value) AS tonality, CAST(arg_min(band, (-value, band)) AS INT) AS band, sum(value) * 0.348088948583815e0 * 0.5e0 AS integrated FROM spec_metric GROUP BY ALL"


@plan(_TON, "tonality integrated")
def tonality_curve(spark, d):
    return S.tonality_curve(D.spec_metric(spark, d)).select("recording", "channel", "t_idx", "tonality", "band", "integrated")


@plan(f"""SELECT recording, channel, avg(tonality) FILTER (tonality > 3) AS mean_max, quantile_cont(tonality, 0.95) FILTER (tonality > 3) AS ex5_max,
 avg(integrated) FILTER (tonality > 3) AS mean_int, quantile_cont(integrated, 0.95) FILTER (tonality > 3) AS ex5_int, count(*) FILTER (tonality > 3) AS n_steps FROM ({_TON}) GROUP BY recording, channel""", "mean_max ex5_max mean_int ex5_int")
def tonality_average(spark, d):
    return S.tonality_average(S.tonality_curve(D.spec_metric(spark, d)), 3.0)


_F = "81.9289e0 / 0.1618e0 * sinh(0.1618e0 * (band + 1) / 2)"


@plan(f"SELECT recording, channel, t_idx, band, value * CASE WHEN {_F} < 1000 THEN 1 ELSE 2.3e0 * (log10({_F}) - 3) + 1 END AS value FROM spec_metric", "value")
def tonal_annoyance_weight(spark, d):
    return S.tonal_annoyance_weight(D.spec_metric(spark, d)).select("recording", "channel", "t_idx", "band", "value")


def _parts(spark, d):
    """Even labels as tonal, the labels after them as noise."""
    spec = D.spec_metric(spark, d)
    tonal = spec.filter("recording % 2 = 0")
    return tonal, spec.filter("recording % 2 = 1").withColumn("recording", F.col("recording") - 1)


_PAIR = "SELECT t.recording, t.channel, t.t_idx, t.band, t.value AS t, n.value AS n FROM spec_metric t JOIN spec_metric n ON n.recording = t.recording + 1 AND n.channel = t.channel AND n.t_idx = t.t_idx AND n.band = t.band WHERE t.recording % 2 = 0"


@plan(f"""SELECT recording, channel, t_idx, band, pow(pow(t, e) + pow(0.5331e0 * n, e), 1 / e) AS value FROM
 (SELECT *, 0.2918e0 / (max(t + n) OVER (PARTITION BY recording, channel, t_idx) + 1e-12) + 0.5459e0 AS e FROM ({_PAIR}))""", "value")
def combine_tonal_noise_loudness(spark, d):
    return S.combine_tonal_noise_loudness(*_parts(spark, d))


@plan(f"""SELECT recording, channel, t_idx, band, t * CASE WHEN c >= 1 THEN 0 ELSE 1 - c END * 2.8758615e0 / 0.9999043734252e0 AS value FROM
 (SELECT *, exp(-35 * (max(t) OVER w / (sum(n) OVER w + 1e-12) - 0.003e0)) AS c FROM ({_PAIR}) WINDOW w AS (PARTITION BY recording, channel, t_idx))""", "value")
def scale_tonality(spark, d):
    return S.scale_tonality(*_parts(spark, d))


_LOUD = "0.0211668e0 * 1.00132e0 * {r} / 2e-5 * " + " * ".join(f"pow(1 + pow({{r}} / (2e-5 * pow(10, {15 + 10 * i} / 20.0e0)), 1.5e0), {(_C.LOUDNESS_V[i + 1] - _C.LOUDNESS_V[i]) / 1.5!r}::DOUBLE)" for i in range(8))
_QUIET = "list_value(" + ", ".join(f"{q}::DOUBLE" for q in _C.QUIET) + ")"


@plan(f"SELECT recording, channel, band, rms * 1000 AS rms_mpa, greatest({_LOUD.format(r='rms')} - {_QUIET}[band + 1], 0) AS loudness FROM (SELECT recording, channel, sample_idx // 8 AS block_idx, CAST(sample_idx // 8 % 53 AS INT) AS band, sqrt(2 * sum(pow(greatest(p, 0), 2)) / count(*)) AS rms FROM signals GROUP BY ALL)", "rms_mpa loudness")
def basis_loudness(spark, d):
    frames = D.signals(spark, d).withColumn("block_idx", F.floor(F.col("sample_idx") / 8)).withColumn("band", (F.col("block_idx") % 53).cast("int"))
    rms = S.block_rms(frames, ["recording", "channel", "block_idx", "band"])
    return S.basis_loudness(rms).select("recording", "channel", "band", (F.col("rms") * 1000).alias("rms_mpa"), "loudness")


@plan(f"""
WITH b AS (SELECT t.recording, CAST(t.sample_idx // 8 AS BIGINT) AS block_idx, CAST(t.sample_idx // 8 % 53 AS INT) AS band, sqrt(2 * sum(pow(greatest(t.p, 0), 2)) / count(*)) AS t, sqrt(2 * sum(pow(greatest(m.p, 0), 2)) / count(*)) AS m, sqrt(2 * sum(pow(greatest(t.p + m.p, 0), 2)) / count(*)) AS s
 FROM signals t JOIN signals m ON m.recording = t.recording AND m.sample_idx = t.sample_idx WHERE t.channel = 0 AND m.channel = 1 GROUP BY ALL),
k AS (SELECT *, {_QUIET}[band + 1] AS quiet, CASE WHEN f >= 1000 THEN pow(10, -0.3e0) ELSE pow(10, ({' + '.join(f'{c!r}::DOUBLE * pow(log10(f), {4 - i})' for i, c in enumerate(_C.MASKED))}) / 10) END AS snr FROM (SELECT *, {_F} AS f FROM b)),
l AS (SELECT recording, block_idx, band, quiet, 0.25e0 + 0.1e0 * snr / (1 + snr) AS c, 1.5e0 + 1.3e0 * snr / (1 + snr) AS r, {_LOUD.format(r='t')} AS t, {_LOUD.format(r='m')} AS m, {_LOUD.format(r='s')} AS s FROM k)
SELECT recording, block_idx, band, CASE WHEN s <= quiet THEN 0 ELSE greatest(pow(pow(greatest((pow(t, 1 / c) - 0.5e0 * pow(m, 1 / c)) / (pow(t, 1 / c) + pow(m, 1 / c) + 1e-12), 0), r) * pow(t, 1 / c), c) - quiet, 0) END AS value FROM l""", "value", digits=5)
def partial_loudness(spark, d):
    s = D.signals(spark, d).withColumn("block_idx", F.floor(F.col("sample_idx") / 8)).withColumn("band", (F.col("block_idx") % 53).cast("int")).withColumnRenamed("sample_idx", "pos")
    part = lambda c: s.filter(F.col("channel") == c).drop("channel")
    return S.partial_loudness(part(0), part(1), ["recording", "block_idx"])


def _sharp_sql(method):
    z = "(band + 1) * 0.5e0"
    cal = f"{0.11 * S.SHARPNESS[method]!r}::DOUBLE"
    if method == "aures":
        w, s = f"0.078e0 * exp(0.171e0 * {z})", f"{cal} * s / (ln(0.05e0 * n + 1) + 2.220446049250313e-16)"
        inner = f"sum(value * {w} * 0.5e0)"
    else:
        q = S._WEIGHTS[method]
        inner = f"sum(value * CASE WHEN {z} >= {q[0]}e0 THEN {q[1]}e0 * exp({q[2]}e0 * ({z} - {q[0]}e0)) + {q[3]}e0 ELSE 1 END * {z} * 0.5e0)"
        s = f"{cal} * s / (n + 2.220446049250313e-16)"
    return f"SELECT recording, channel, t_idx, CASE WHEN n = 0 THEN 0 ELSE {s} END AS value FROM (SELECT recording, channel, t_idx, sum(value) * 0.5e0 AS n, {inner} AS s FROM spec_metric GROUP BY ALL)"


for _m in S.SHARPNESS:
    plan(_sharp_sql(_m), "value", name=f"sharpness_{_m}")(lambda spark, d, m=_m: S.sharpness_curve(D.spec_metric(spark, d), m))


@plan("""SELECT recording, channel, t_idx, band, 1.1e0 * pow(value, (0.95555e0 - 0.58449e0) * (tanh(1.6407e0 * (CASE WHEN mean = 0 THEN 0 ELSE rms / mean END - 2.5804e0)) + 1) * 0.5e0 + 0.58449e0) AS value
FROM (SELECT *, sqrt(avg(value * value) OVER w) AS rms, avg(value) OVER w AS mean FROM spec_metric WINDOW w AS (PARTITION BY recording, channel, t_idx))""", "value")
def roughness_transform(spark, d):
    return S.roughness_transform(D.spec_metric(spark, d), 1.1)


_MA = "SELECT recording, channel, t_idx, band, CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END AS value FROM spec_metric WINDOW w AS (PARTITION BY recording, channel, band ORDER BY t_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


@plan(_MA, "value")
def moving_average(spark, d):
    return S.moving_average(D.spec_metric(spark, d), 3)


@plan(f"WITH m AS ({_MA}) SELECT c.recording, c.channel, c.t_idx, c.band, CASE WHEN c.value IS NULL AND a.value IS NULL THEN NULL ELSE greatest(c.value - a.value, CASE WHEN a.value IS NOT NULL THEN 0 END) END AS value FROM m c JOIN m a ON a.recording = 0 AND a.channel = c.channel AND a.t_idx = c.t_idx AND a.band = c.band WHERE c.recording <> 0", "value")
def positive_difference(spark, d):
    spec = D.spec_metric(spark, d)
    out = S.positive_difference(spec.filter("recording <> 0").withColumn("ambient_id", F.lit(0)), spec.filter("recording = 0"), 3)
    return out.select("recording", "channel", "t_idx", "band", "value")


@plan("SELECT recording, channel, t_idx, band, CASE WHEN count(*) OVER w = 3 THEN avg(value) OVER w ELSE value END AS value FROM spec_metric WINDOW w AS (PARTITION BY recording, channel, t_idx ORDER BY band ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)", "value")
def band_smooth(spark, d):
    return S.band_smooth(D.spec_metric(spark, d))


_IMP = f"SELECT *, greatest(value - base, 0) AS impulse FROM (SELECT *, quantile_cont(value, 0.05) OVER (PARTITION BY recording, channel ORDER BY t_idx RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS base FROM ({CURVE}))"


@plan(_IMP, "value base impulse")
def impulsive_loudness(spark, d):
    return S.impulsive_loudness(curve(spark, d), 5)


@plan(f"SELECT recording, channel, avg(impulse) AS impulse_mean, pow(avg(pow(impulse, 1 / log10(2))), log10(2)) AS impulse_power FROM ({_IMP}) GROUP BY ALL", "impulse_mean impulse_power")
def impulsive_summary(spark, d):
    return S.impulsive_summary(S.impulsive_loudness(curve(spark, d), 5))


def _thirds(spark, d):
    x = D.third_octaves(spark, d)
    return x.filter("recording % 2 = 0"), x.filter("recording % 2 = 1").withColumn("recording", F.col("recording") - 1)


def _list(values):
    return "list_value(" + ", ".join(f"{v!r}::DOUBLE" for v in values) + ")"


_DET = f"""SELECT *, target_db + a_weight AS target_dba, masker_db + a_weight AS masker_dba, discounted_db + a_weight AS discounted_dba FROM (SELECT recording, channel, t_idx, band, target_db, masker_db, a_weight, d_prime, 3 / (d_prime / 14) AS discount_db, target_db - 3 / (d_prime / 14) AS discounted_db FROM (
 SELECT *, eff * 4e-10 * pow(10, target_db / 10) / (4e-10 * pow(10, masker_db / 10) + eff * pow(2e-5 * pow(10, {_list(_C.HEARING_THRESHOLDS)}[band + 1] / 20), 2) / 2) AS d_prime, {_list(_C.A_WEIGHTS)}[band + 1] AS a_weight FROM (
  SELECT *, 0.3e0 * sqrt(0.5e0) * sqrt(bw) * sqrt(bw / (24.7e0 * (1 + 4.37e0 / 1000 * f))) * pow(10, CASE WHEN f >= 2500 THEN -6 * pow(log10(f / 2500), 2) ELSE 0 END / 10) AS eff FROM (
   SELECT *, f * (pow(10, 0.05e0) - pow(10, -0.05e0)) AS bw FROM (
    SELECT t.recording, t.channel, t.t_idx, t.band, t.level_db AS target_db, m.level_db AS masker_db, 1000 * pow(10, 0.3e0 * (t.band - 17) / 3) AS f FROM thirds t
    JOIN thirds m ON m.recording = t.recording + 1 AND m.channel = t.channel AND m.t_idx = t.t_idx AND m.band = t.band WHERE t.recording % 2 = 0)))))"""


@plan(_DET, "target_db masker_db a_weight d_prime discount_db discounted_db target_dba masker_dba discounted_dba", digits=5)
def detectability_spectrum(spark, d):
    return B.detectability_spectrum(*_thirds(spark, d))


@plan(f"""SELECT *, laeq_target - laeq_discounted AS dba_discount, lae_target - (laeq_target - laeq_discounted) AS lae_discounted FROM (SELECT recording, channel, 10 * log10(max(top)) AS max_db, 10 * log10(max(rss)) AS int_max_db, 10 * log10(0.5e0 * sum(rss)) AS int_db, 10 * log10(0.5e0 * sum(top)) AS max_int_db,
 quantile_cont(10 * log10(top), 0.5) AS max_ex50, quantile_cont(10 * log10(rss), 0.5) AS int_ex50, 10 * log10(avg(target)) AS laeq_target, 10 * log10(avg(discounted)) AS laeq_discounted, 10 * log10(avg(masker)) AS laeq_masker, 10 * log10(0.5e0 * sum(target)) AS lae_target, 10 * log10(0.5e0 * sum(masker)) AS lae_masker
FROM (SELECT *, min(t_idx) OVER (PARTITION BY recording, channel) AS a, max(t_idx) OVER (PARTITION BY recording, channel) AS b FROM
 (SELECT recording, channel, t_idx, max(d_prime) AS top, sqrt(sum(d_prime * d_prime)) AS rss, sum(pow(10, (target_db + a_weight) / 10)) AS target, sum(pow(10, (masker_db + a_weight) / 10)) AS masker, sum(pow(10, (discounted_db + a_weight) / 10)) AS discounted FROM ({_DET}) GROUP BY recording, channel, t_idx))
WHERE t_idx >= a + 1 AND t_idx <= b - 1 GROUP BY recording, channel)""", "max_db int_max_db int_db max_int_db max_ex50 int_ex50 laeq_target laeq_discounted dba_discount laeq_masker lae_target lae_masker lae_discounted", digits=5)
def detectability_summary(spark, d):
    return B.detectability_summary(B.detectability_spectrum(*_thirds(spark, d)), skip=(1, 1))


_MET = "SELECT recording, channel, t_idx, 1 + value AS loud, 0.8e0 + value / 10 AS sharp, value / 20 AS fluct, value / 15 AS rough, value / 30 AS tonal, value / 9 AS impuls FROM (" + CURVE + ")"
_WS = "pow(CASE WHEN sharp <= 1.75 THEN 0 ELSE (sharp - 1.75e0) * 0.25e0 * log10(loud + 10) END, 2)"
_WM = "pow(2.18e0 / pow(loud, 0.4e0) * (0.4e0 * fluct + 0.6e0 * rough), 2)"
_WT = "pow((1 - exp(-0.29e0 * loud)) * (1 - exp(-5.49e0 * tonal)), 2)"


@plan(f"""SELECT recording, channel, t_idx, loud * (1 + sqrt({_WS} + {_WM})) AS widmann, loud * (1 + sqrt(greatest(0, -0.16e0 + 11.48e0 * {_WS} + 0.84e0 * {_WM} + 1.25e0 * {_WT}))) AS more,
 0.86e0 * loud * sharp + 1.81e0 * rough + 1.24e0 * impuls + 27.73e0 AS willemsen, loud * (1 + sqrt({_WS} + {_WM} + pow(6.41e0 * tonal / pow(loud, 0.52e0), 2))) AS di,
 loud * (1 + sqrt(greatest(0, 103.08e0 + 339.49e0 * {_WS} + 121.88e0 * {_WM} + 77.2e0 * {_WT} + 29.29e0 * pow(0.075e0 * impuls * pow(loud, 1.334e0), 2)))) AS torija,
 loud * (1 + sqrt({_WS} + {_WM} + pow(3.2e0 * tonal / loud, 2))) AS boucher FROM ({_MET})""", "widmann more willemsen di torija boucher", digits=5)
def psych_annoyance(spark, d):
    v = F.col("value")
    m = {"loud": 1 + v, "sharp": 0.8 + v / 10, "rough": v / 15, "fluct": v / 20, "tonal": v / 30, "impuls": v / 9}
    return curve(spark, d).select("recording", "channel", "t_idx", *[A.psych_annoyance(x, **m).alias(x) for x in ("widmann", "more", "willemsen", "di", "torija", "boucher")])


@plan(f"""WITH c AS (SELECT recording, t_idx, avg(value) AS value FROM ({CURVE}) GROUP BY ALL)
SELECT recording, t_idx, CASE WHEN loud > 0 THEN loud * (1 + sqrt({_WS} + {_WM})) ELSE 0 END AS value FROM (SELECT recording, t_idx, value AS loud, value / 8 AS sharp, value / 20 AS fluct, value / 15 AS rough FROM c)""", "value")
def psych_annoyance_curve(spark, d):
    c = curve(spark, d).groupBy("recording", "t_idx").agg(F.avg("value").alias("value"))
    part = lambda k: c.withColumn("value", F.col("value") / k)
    return B.psych_annoyance_curve(c, part(8), part(20), part(15))


@plan(f"""SELECT recording, channel, t_idx, CASE WHEN loud > 0 THEN loud * (1 + sqrt({_WS} + {_WM})) ELSE 0 END AS value FROM (SELECT recording, channel, t_idx, value AS loud, value / 8 AS sharp, value / 20 AS fluct, value / 15 AS rough FROM ({CURVE}))""", "value")
def psych_annoyance_curve_channels(spark, d):
    """psych_annoyance_curve of both channels."""
    c = curve(spark, d).select("recording", "channel", "t_idx", "value")
    part = lambda k: c.withColumn("value", F.col("value") / k)
    return B.psych_annoyance_curve(c, part(8), part(20), part(15), ["recording", "channel"])


@plan("""WITH b AS (SELECT i, 1000 * pow(10, 0.3e0 * (i - 17) / 3) AS f FROM range(0, 31) t(i)), x AS (SELECT recording, channel, band * 10 + 20 AS freq, value * value AS power FROM spec_metric)
SELECT recording, channel, CAST(i AS INT) AS band, CASE WHEN sum(power) > 0 THEN 10 * log10(sum(power) / 4e-10) END AS level_db FROM x JOIN b ON freq >= f / pow(10, 0.05e0) AND freq < f * pow(10, 0.05e0) GROUP BY ALL""", "level_db")
def bins_to_bands(spark, d):
    x = D.spec_metric(spark, d).select("recording", "channel", (F.col("band") * 10 + 20).cast("double").alias("freq"), (F.col("value") * F.col("value")).alias("power"))
    return B.bins_to_bands(x, B.octave_bands(spark, 20, 20000, 3))


@plan("""WITH b AS (SELECT i, 1000 * pow(10, 0.3e0 * (i - 17) / 3) AS f FROM range(0, 31) t(i)), x AS (SELECT recording, channel, t_idx, band * 10 + 20 AS freq, value * value AS power FROM spec_metric)
SELECT recording, channel, t_idx, CAST(i AS INT) AS band, CASE WHEN sum(power) > 0 THEN 10 * log10(sum(power) / 4e-10) END AS level_db FROM x JOIN b ON freq >= f / pow(10, 0.05e0) AND freq < f * pow(10, 0.05e0) GROUP BY ALL""", "level_db")
def bins_to_bands_frames(spark, d):
    """bins_to_bands of every frame."""
    x = D.spec_metric(spark, d).select("recording", "channel", "t_idx", (F.col("band") * 10 + 20).cast("double").alias("freq"), (F.col("value") * F.col("value")).alias("power"))
    return B.bins_to_bands(x, B.octave_bands(spark, 20, 20000, 3), ["recording", "channel", "t_idx"])


def _dft(window: str) -> str:
    """Power of each block and bin of 16 samples, 8 apart."""
    return f"""SELECT recording, channel, block_idx, k, (pow(sum(w * p * cos(2 * pi() * k * pos / 16)), 2) + pow(sum(w * p * sin(2 * pi() * k * pos / 16)), 2)) / pow(sum(w), 2) * CASE WHEN k = 0 THEN 1 ELSE 2 END AS power
FROM (SELECT *, {window} AS w FROM (SELECT *, sample_idx - block_idx * 8 AS pos FROM (SELECT recording, channel, sample_idx, p, unnest(range(greatest(0, CAST(ceil((sample_idx - 15) / 8.0e0) AS BIGINT)), sample_idx // 8 + 1)) AS block_idx FROM signals))), range(0, 9) t(k)
GROUP BY recording, channel, block_idx, k HAVING count(*) = 16"""


@plan(f"SELECT recording, channel, CAST(k AS INT) AS bin, k * 8 / 16.0e0 AS freq, avg(power) AS power, sqrt(avg(power)) AS rms, sqrt(2 * avg(power)) AS peak, avg(power) / 0.5e0 AS psd, 1.0e0 AS noise_bandwidth FROM ({_dft('1.0e0')}) WHERE k < 8 GROUP BY recording, channel, k", "freq power rms peak psd noise_bandwidth")
def autospectrum(spark, d):
    return Q.autospectrum(D.signals(spark, d), D.RATE, 16)


@plan("SELECT recording, channel, block_idx, sum(p * p) AS energy FROM (SELECT recording, channel, unnest(range(greatest(0, CAST(ceil((sample_idx - 15) / 8.0e0) AS BIGINT)), sample_idx // 8 + 1)) AS block_idx, p FROM signals) GROUP BY ALL HAVING count(*) = 16", "energy")
def frame_blocks(spark, d):
    f = Q.frame_blocks(D.signals(spark, d), 16, 0.5)
    return f.select("recording", "channel", "block_idx", F.aggregate("frame", F.lit(0.0), lambda a, x: a + x * x).alias("energy"))


@plan(f"SELECT recording, channel, block_idx, k * 8 / 16.0e0 AS freq, 10 * log10(power / 4e-10) AS level_db FROM ({_dft('0.5e0 - 0.5e0 * cos(2 * pi() * pos / 15)')})", "freq level_db", digits=4)
def spectrogram(spark, d):
    return Q.spectrogram(D.signals(spark, d), D.RATE, 16)


@plan("""WITH RECURSIVE s AS (SELECT recording, channel, sample_idx, p FROM signals), k AS (SELECT exp(-1 / (1.0e0 * 8)) AS k),
r AS (SELECT recording, channel, sample_idx, p * p AS y FROM s WHERE sample_idx = 0 UNION ALL SELECT s.recording, s.channel, s.sample_idx, (1 - k) * s.p * s.p + k * r.y FROM r JOIN s ON s.recording = r.recording AND s.channel = r.channel AND s.sample_idx = r.sample_idx + 1 CROSS JOIN k)
SELECT recording, channel, sample_idx, sqrt(y) AS weighted FROM r""", "weighted")
def time_weight(spark, d):
    return Q.time_weight(D.signals(spark, d), D.RATE, 1.0).select("recording", "channel", "sample_idx", "weighted")


@plan()
def a_weight_time(spark, d):
    return Q.a_weight_time(D.signals(spark, d), D.RATE)


@plan("""WITH RECURSIVE r AS (SELECT recording, channel, t_idx, band, value, value AS smoothed FROM spec_metric WHERE t_idx = 0 UNION ALL
SELECT s.recording, s.channel, s.t_idx, s.band, s.value, s.value * (1 - k) + r.smoothed * k FROM r JOIN spec_metric s ON s.recording = r.recording AND s.channel = r.channel AND s.band = r.band AND s.t_idx = r.t_idx + 1,
LATERAL (SELECT CASE WHEN s.value >= r.smoothed THEN exp(-1 / (50 * 0.0625e0)) ELSE exp(-1 / (50 * 0.5e0)) END AS k)) SELECT recording, channel, t_idx, band, value, smoothed FROM r""", "value smoothed")
def asymmetric_lowpass(spark, d):
    return Q.asymmetric_lowpass(D.spec_metric(spark, d), 50.0)


@plan("""WITH RECURSIVE k AS (SELECT d, pow(1 - d, 3) / (d + d * d) AS g FROM (SELECT exp(-1 / (187.5e0 * 6 / 224)) AS d)),
r AS (SELECT recording, channel, t_idx, band, value, 0.0e0 AS smoothed, 0.0e0 AS y1, 0.0e0 AS y2, 0.0e0 AS x1 FROM spec_metric WHERE t_idx = 0 UNION ALL
SELECT s.recording, s.channel, s.t_idx, s.band, s.value, g * (d * r.value + d * d * r.x1) + 3 * d * r.smoothed - 3 * d * d * r.y1 + d * d * d * r.y2, r.smoothed, r.y1, r.value
FROM r JOIN spec_metric s ON s.recording = r.recording AND s.channel = r.channel AND s.band = r.band AND s.t_idx = r.t_idx + 1 CROSS JOIN k)
SELECT recording, channel, t_idx, band, value, smoothed FROM r""", "value smoothed")
def noise_reduction_lowpass(spark, d):
    return Q.noise_reduction_lowpass(D.spec_metric(spark, d), 187.5)


@plan(f"""WITH c AS (SELECT recording, channel, t_idx * 1.0e0 AS t, value FROM ({CURVE})) SELECT a.recording, a.channel, a.t + 0.25e0 AS t, a.value + (b.value - a.value) * 0.25e0 AS value FROM c a LEFT JOIN c b ON b.recording = a.recording AND b.channel = a.channel AND b.t = a.t + 1""", "t value")
def resample_linear(spark, d):
    c = curve(spark, d).select("recording", "channel", F.col("t_idx").cast("double").alias("t"), "value")
    return Q.resample_linear(c, c.select("recording", "channel", (F.col("t") + 0.25).alias("t")))


@plan()
def resample_cubic(spark, d):
    """The curve of resample_linear halfway between its steps, on the monotone cubic."""
    c = curve(spark, d).select("recording", "channel", F.col("t_idx").cast("double").alias("t"), "value")
    return Q.resample(c, c.select("recording", "channel", (F.col("t") + 0.5).alias("t")), cubic=True)


def _overall(loud, sharp, fluct, rough):
    """Annoyance of the recordings in c (recording, channel, value), given the aggregates of each curve."""
    return f"""SELECT recording, channel, CASE WHEN loud > 0 THEN loud * (1 + sqrt({_WS} + {_WM})) ELSE 0 END AS annoyance FROM (
 SELECT recording, channel, {loud} AS loud, {sharp} AS sharp, {fluct} AS fluct, {rough} AS rough FROM (SELECT recording, channel, value AS l, value / 8 AS s, CASE WHEN t_idx % 2 = 0 THEN value / 20 END AS f, value / 15 AS r FROM ({CURVE})) GROUP BY ALL)"""


_POWER_AVERAGE = "pow(avg(pow({}, 1 / log10(2))), log10(2))"


def _annoyance_overall(spark, d, form):
    c = curve(spark, d).select("recording", "channel", "t_idx", "value")
    part = lambda k: c.withColumn("value", F.col("value") / k)
    return B.psych_annoyance_overall(c, part(8), part(20).filter("t_idx % 2 = 0"), part(15), ["recording", "channel"], form)  # fluctuation at half the rate


@plan(_overall("quantile_cont(l, 0.95)", "quantile_cont(s, 0.95)", "quantile_cont(f, 0.95)", "quantile_cont(r, 0.95)"), "annoyance")
def psych_annoyance_percentiles(spark, d):
    return _annoyance_overall(spark, d, "percentiles")


@plan(_overall(_POWER_AVERAGE.format("l"), _POWER_AVERAGE.format("s"), "quantile_cont(f, 0.9)", "quantile_cont(r, 0.9)"), "annoyance")
def psych_annoyance_averages(spark, d):
    return _annoyance_overall(spark, d, "averages")


@plan(f"""WITH c AS (SELECT recording, channel, t_idx, value FROM ({CURVE})) SELECT a.recording, a.channel, a.t_idx * 0.5e0 AS t, a.value AS loud, CASE WHEN a.t_idx % 2 = 0 THEN a.value / 8 ELSE (b.value + e.value) / 16 END AS sharp
FROM c a LEFT JOIN c b ON b.recording = a.recording AND b.channel = a.channel AND b.t_idx = a.t_idx - 1 LEFT JOIN c e ON e.recording = a.recording AND e.channel = a.channel AND e.t_idx = a.t_idx + 1""", "t loud sharp")
def align_curves(spark, d):
    c = curve(spark, d).select("recording", "channel", "t_idx", (F.col("t_idx") * 0.5).alias("t"), "value")
    half = c.filter("t_idx % 2 = 0").withColumn("value", F.col("value") / 8)
    return Q.align_curves({"loud": c, "sharp": half}, "loud")


@plan(f"""SELECT recording, channel, target_dba - dba_discount AS leq_discounted, target_lae - dba_discount AS le_discounted FROM (SELECT recording, channel, 10 * log10(avg(target)) AS target_dba, 10 * log10(0.5e0 * sum(target)) AS target_lae, 10 * log10(avg(target)) - 10 * log10(avg(discounted)) AS dba_discount
FROM (SELECT recording, channel, t_idx, sum(pow(10, target_dba / 10)) AS target, sum(pow(10, discounted_dba / 10)) AS discounted FROM ({_DET}) GROUP BY ALL) GROUP BY ALL)""", "leq_discounted le_discounted", digits=5)
def detection_discounted_level(spark, d):
    x = B.detectability_summary(B.detectability_spectrum(*_thirds(spark, d)))
    x = R.detection_discounted_level(x, {"leq_discounted": ("laeq_target", "dba_discount"), "le_discounted": ("lae_target", "dba_discount")})
    return x.select("recording", "channel", "leq_discounted", "le_discounted")


def _folder(spark):
    return shared_folder(spark)


@plan("SELECT event_id, event_type, value, 'a.csv' AS source_file FROM events", "value")
def read_response_csvs(spark, d):
    """The events written as CSV files of one folder, and read again with the file that each row comes from (its name is made one here)."""
    folder = _folder(spark)
    rows = D.table(spark, d, "events").select("event_id", "event_type", "value")
    files.write_tables(rows, folder, "csv")
    back = files.read_response_csvs(spark, folder, rows.schema)
    return back.withColumn("source_file", F.when(F.col("source_file").endswith(".csv"), "a.csv"))


@plan("SELECT recording, channel, t_idx * 1.0e0 AS t, band * 0.5e0 AS band, value FROM spec_metric", "t band value")
def read_spec_matrix(spark, d):
    """Band values written as text matrices, one file for each recording and channel, and read again."""
    folder = _folder(spark)
    spec = D.spec_metric(spark, d)
    steps = spec.groupBy("recording", "channel", "t_idx").agg(F.array_sort(F.collect_list(F.struct("band", "value"))).alias("v"))
    line = lambda first, cells: F.concat_ws("\t", F.array(first), cells).alias("value")
    body = steps.select("recording", "channel", F.col("t_idx").alias("i"), line(F.col("t_idx").cast("double").cast("string"), F.transform("v", lambda x: x["value"].cast("string"))))
    head = steps.groupBy("recording", "channel").agg(F.first("v").alias("v")).select("recording", "channel", F.lit(-1).alias("i"), line(F.lit("NaN"), F.transform("v", lambda x: (x["band"] * 0.5).cast("string"))))
    name = F.concat_ws("_", "recording", "channel").alias("name")
    rows = body.union(head).select(name, "i", "value").repartition("name").sortWithinPartitions("name", "i")
    rows.select("name", "value").write.partitionBy("name").text(folder)
    back = files.read_spec_matrix(spark, f"{folder}/name=*", name=r"name=([^/]+)")
    key = F.split("source_file", "_")
    return back.select(F.get(key, F.lit(0)).cast("int").alias("recording"), F.get(key, F.lit(1)).cast("int").alias("channel"), "t", "band", "value")


@plan("SELECT recording, channel, count(*) AS n, 10 * log10(avg(p * p) / 4e-10) AS leq FROM signals GROUP BY ALL", "leq")
def write_tables(spark, d):
    """A result written as Parquet in folders by channel, and read again."""
    folder = _folder(spark)
    files.write_tables(L.level_stats(D.signals(spark, d), D.RATE).select("recording", "channel", "n", "leq"), folder, partition_by=["channel"])
    return spark.read.parquet(folder).select("recording", F.col("channel").cast("int").alias("channel"), "n", "leq")
