"""Queries on correlations, predictions, draws and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import responses as R
from ..operators import scoring as C
from ..operators import sequences as Q
from ..operators import stats as S
from ..runtime import shared_folder
from ..sources import adapters as D
from ..streaming import monitor
from .registry import plan
from .study import base, changed

_PRED = """SELECT l_orderkey, CAST(l_quantity > 25 AS INT) AS y, 0.05e0 + l_discount * 8 AS mu, l_quantity / 50 AS yc, CAST(o_custkey % 6 AS INT) AS fold, o_custkey AS participant, CAST(l_partkey % 50 AS INT) AS stimulus, l_tax AS tax FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""


def predictions(spark, d):
    x = D.table(spark, d, "lineitem").join(D.table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return x.select("l_orderkey", (F.col("l_quantity") > 25).cast("int").alias("y"), (0.05 + F.col("l_discount") * 8).alias("mu"), (F.col("l_quantity") / 50).alias("yc"), (F.col("o_custkey") % 6).cast("int").alias("fold"), F.col("o_custkey").alias("participant"), (F.col("l_partkey") % 50).cast("int").alias("stimulus"), F.col("l_tax").alias("tax"))


_CI = "tanh(atanh(r) - 1.959963984540054e0 / sqrt(n - 3)) AS low, tanh(atanh(r) + 1.959963984540054e0 / sqrt(n - 3)) AS high"


@plan(f"SELECT a, b, r, n, {_CI} FROM (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', corr(l_quantity, l_tax), count(*) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', corr(l_extendedprice, l_tax), count(*) FROM lineitem)", "r low high")
def correlation_pearson(spark, d):
    return S.correlation_matrix(D.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])


_RANKS = "SELECT avg(0) FILTER (false) AS z, l_quantity, (rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0e0) AS rq, (rank() OVER (ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2.0e0) AS rt, (rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0e0) AS rd FROM lineitem".replace("avg(0) FILTER (false) AS z, ", "")


@plan(f"SELECT 'l_quantity' AS a, 'l_tax' AS b, r, n, {_CI} FROM (SELECT corr(rq, rt) AS r, count(*) AS n FROM ({_RANKS}))", "r low high")
def correlation_spearman(spark, d):
    return S.correlation_matrix(D.table(spark, d, "lineitem"), ["l_quantity", "l_tax"], "spearman")


@plan(f"""WITH t AS (SELECT l_discount AS x, l_tax AS y, count(*) * 1.0e0 AS k FROM lineitem GROUP BY ALL)
SELECT a, b, r, n, {_CI} FROM (SELECT 'l_discount' AS a, 'l_tax' AS b, s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)) AS r, CAST(n AS BIGINT) AS n FROM
 (SELECT sum(CASE WHEN u.y > t.y THEN t.k * u.k ELSE -t.k * u.k END) AS s FROM t JOIN t u ON t.x < u.x AND t.y <> u.y),
 (SELECT sum(c * (c - 1) / 2) AS tx FROM (SELECT sum(k) AS c FROM t GROUP BY x)), (SELECT sum(c * (c - 1) / 2) AS ty FROM (SELECT sum(k) AS c FROM t GROUP BY y)), (SELECT sum(k) AS n FROM t))""", "r low high")
def correlation_kendall(spark, d):
    return S.correlation_matrix(D.table(spark, d, "lineitem"), ["l_discount", "l_tax"], "kendall")


@plan()
def correlation_kendall_columns(spark, d):
    """Kendall's tau of the columns that correlation_pearson takes."""
    return S.correlation_matrix(D.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], "kendall")


_ICC = "SELECT lvl, ambient, avg(rating) AS y FROM ratings GROUP BY ALL"


@plan(f"""WITH c AS ({_ICC}), g AS (SELECT avg(y) AS g, sum(y * y) AS q, count(*) AS cells FROM c), s AS (SELECT count(*) AS n, sum(m * m) AS ss FROM (SELECT avg(y) AS m FROM c GROUP BY lvl)), r AS (SELECT count(*) AS k, sum(m * m) AS rr FROM (SELECT avg(y) AS m FROM c GROUP BY ambient))
SELECT n, k, (msr - mse) / msr AS icc FROM (SELECT n, k, (k * ss - cells * g * g) / (n - 1) AS msr, ((q - cells * g * g) - (k * ss - cells * g * g) - (n * rr - cells * g * g)) / ((n - 1) * (k - 1)) AS mse FROM g, s, r)""", "icc", digits=4)
def icc_consistency(spark, d):
    cells = D.ratings(spark, d).groupBy("lvl", "ambient").agg(F.avg("rating").alias("y"))
    return S.icc_consistency(cells, "lvl", "ambient", "y")


_PAIRS = "SELECT participant, ambient, max(rating) FILTER (lvl = 2) AS a, max(rating) FILTER (lvl = 3) AS b FROM ratings GROUP BY ALL"


def pairs(spark, d):
    r = D.ratings(spark, d).withColumn("participant", F.concat_ws("_", "participant", "ambient"))
    w = R.to_wide(r, "participant", "lvl", "rating", [2, 3])
    return w.select("participant", F.col("2").alias("a"), F.col("3").alias("b"))


@plan(f"SELECT n, mean, sd, r, mean / sd AS cohen_d, (mean + 0.5) / (sd / sqrt(n)) AS t_low, (mean - 0.5) / (sd / sqrt(n)) AS t_high FROM (SELECT count(*) AS n, avg(a - b) AS mean, stddev_samp(a - b) AS sd, corr(a, b) AS r FROM ({_PAIRS}) WHERE a IS NOT NULL AND b IS NOT NULL)", "mean sd r cohen_d t_low t_high")
def paired_difference(spark, d):
    return S.paired_difference(pairs(spark, d), "participant", "a", "b", 0.5)


@plan()
def equivalence_test(spark, d):
    return Q.tost_p(S.paired_difference(pairs(spark, d), "participant", "a", "b", 0.5))


@plan()
def permutation_test(spark, d):
    r = R.change_from_baseline(D.ratings(spark, d), ["participant", "ambient"], base(), ["rating"]).withColumn("zero", F.lit(0.0))
    return Q.permutation_test(r.filter(~base()), ["stimulus"], "d_rating", "zero")


_M = "count(*) AS n, avg((yc - mu) * (yc - mu)) AS mse, avg(abs(yc - mu)) AS mae, var_pop(yc) AS vy, var_samp(mu) AS vm, var_samp(yc - mu) AS ve"


@plan(f"""WITH p AS ({_PRED}), f AS (SELECT fold, n, mse, sqrt(mse) AS rmse, mae, 1 - mse / vy AS r2, vm / (vm + ve) AS gelman_r2 FROM (SELECT fold, {_M} FROM p GROUP BY fold UNION ALL SELECT -1, {_M} FROM p))
SELECT f.*, (SELECT stddev_samp(rmse) / sqrt(count(*)) FROM f WHERE fold >= 0) AS rmse_se, (SELECT stddev_samp(mae) / sqrt(count(*)) FROM f WHERE fold >= 0) AS mae_se, (SELECT stddev_samp(r2) / sqrt(count(*)) FROM f WHERE fold >= 0) AS r2_se FROM f""", "mse rmse mae r2 gelman_r2 rmse_se mae_se r2_se")
def cv_metrics(spark, d):
    return S.cv_metrics(predictions(spark, d), "yc", "mu", "fold")


@plan(f"SELECT count(*) AS n, sqrt(avg((y - mu) * (y - mu))) AS rmse, avg(abs(y - mu)) AS mae, 1 - avg((y - mu) * (y - mu)) / var_pop(y) AS r2 FROM (SELECT stimulus, avg(yc * 10) AS y, avg(mu * 10) AS mu FROM ({_PRED}) GROUP BY stimulus)", "rmse mae r2")
def cv_metrics_by_stimulus(spark, d):
    return S.cv_metrics_by_stimulus(predictions(spark, d), "yc", "mu", "stimulus", lambda c: c * 10)


@plan(f"""SELECT (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0e0) / (sum(y) * (count(*) - sum(y))) AS auc, avg(mu) FILTER (y = 1) - avg(mu) FILTER (y = 0) AS tjur, -avg(y * ln(mu) + (1 - y) * ln(1 - mu)) AS log_loss
FROM (SELECT y, mu, rank() OVER (ORDER BY mu) + (count(*) OVER (PARTITION BY mu) - 1) / 2.0e0 AS rk FROM ({_PRED}))""", "auc tjur log_loss")
def binary_metrics(spark, d):
    return S.binary_metrics(predictions(spark, d), "y", "mu")


@plan(f"SELECT margin, (SELECT count(*) FILTER (abs(yc - mu) <= margin) * 1.0e0 / count(*) FROM ({_PRED})) AS coverage FROM (SELECT r AS margin FROM (SELECT abs(yc - mu) AS r, row_number() OVER (ORDER BY abs(yc - mu)) AS k, count(*) OVER () AS n FROM ({_PRED})) WHERE k = least(ceil(0.9 * (n + 1)), n))", "margin coverage")
def conformal_margin(spark, d):
    return S.conformal_margin(predictions(spark, d), "yc", "mu", 0.9)


@plan(f"""SELECT 1 - avg((yc - mu) * (yc - mu)) / var_pop(yc) AS r2, sqrt(avg(o * o)) AS rmse_outside, 100 * avg(CAST(o = 0 AS INT)) AS percent_inside, avg(CASE WHEN y = 1 THEN mu ELSE 1 - mu END) AS percent_correct,
 1 - sum(mu * ln(mu) + (1 - mu) * ln(1 - mu)) / (count(y) * (avg(y) * ln(avg(y)) + (1 - avg(y)) * ln(1 - avg(y)))) AS entropy_reduction FROM (SELECT *, greatest(yc - 0.3e0 - mu, mu - (yc + 0.25e0), 0) AS o FROM ({_PRED}))""", "r2 rmse_outside percent_inside percent_correct entropy_reduction")
def fit_scores(spark, d):
    p = predictions(spark, d).withColumn("low", F.col("yc") - 0.3).withColumn("high", F.col("yc") + 0.25)
    one = S.fit_scores(p, "yc", "mu", "low", "high").join(S.percent_correct(p, "y", "mu"))
    return one.join(S.entropy_reduction(p, "y", "mu"))


_DRAWS = "SELECT label, CAST(i - 1 AS INT) AS draw, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings)"


def draws(spark, d):
    return D.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("draw", "value")).withColumn("value", F.col("value").cast("double"))


@plan(f"SELECT label, avg(m) AS mean, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM (SELECT label, draw, avg(value) AS m FROM ({_DRAWS}) GROUP BY ALL) GROUP BY label", "mean low high")
def draw_averages(spark, d):
    return S.draw_averages(draws(spark, d), ["label"])


def _contrast(on):
    return f"""WITH m AS (SELECT label AS level, draw, avg(value) AS m FROM ({_DRAWS}) GROUP BY ALL), x AS (SELECT a.level, b.level AS level2, b.m - a.m AS d FROM m a JOIN m b ON a.draw = b.draw AND {on})
SELECT *, CASE WHEN inside >= 0.975 THEN 'equivalent' WHEN inside <= 0.025 THEN 'different' ELSE 'undecided' END AS decision FROM (SELECT level, level2, avg(d) AS mean, greatest(avg(CAST(d > 0 AS INT)), avg(CAST(d < 0 AS INT))) AS direction, avg(CAST(abs(d) <= 0.02 AS INT)) AS inside FROM x GROUP BY ALL)"""


for _kind, _on in (("pairwise", "b.level > a.level"), ("reference", "a.level = 0 AND b.level <> 0"), ("sequential", "b.level = a.level + 1")):
    plan(_contrast(_on), "mean direction inside", name=f"draw_contrasts_{_kind}")(lambda spark, d, k=_kind: S.draw_contrasts(draws(spark, d), "label", k, 0, 0.02))


@plan(f"SELECT draw, min(value) AS low, max(value) AS high FROM ({_DRAWS}) GROUP BY draw", "low high")
def envelope(spark, d):
    return S.envelope(draws(spark, d), "draw", "value")


@plan("""SELECT variable, vif, 1 / vif AS tolerance, CASE WHEN vif >= 10 THEN 'high' WHEN vif >= 5 THEN 'moderate' ELSE 'low' END AS severity FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_tax']) AS variable, unnest([(1 - bc * bc) / d, (1 - ac * ac) / d, (1 - ab * ab) / d]) AS vif
FROM (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS d FROM (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_tax) AS ac, corr(l_extendedprice, l_tax) AS bc FROM lineitem)))""", "vif tolerance")
def variance_inflation(spark, d):
    return S.variance_inflation(D.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])


@plan()
def principal_components(spark, d):
    x = D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", "l_discount")
    return S.principal_components(x, ["l_quantity", "l_extendedprice", "l_tax", "l_discount"], 2, ["l_orderkey", "l_linenumber"])


@plan()
def logit_exposure_response(spark, d):
    p = S.logit_exposure_response(predictions(spark, d), "y", ["mu", "tax"], "fold")
    return p.select("l_orderkey", "fold", "y", "p")


@plan()
def calibration(spark, d):
    return S.calibration(predictions(spark, d), "y", "mu")


@plan(f"SELECT lvl, avg(d_rating) AS mean_change, avg(rating) AS mean_x, count(*) AS n FROM (SELECT *, CASE WHEN lvl = 1 THEN 0 ELSE rating - max(rating) FILTER (lvl = 1) OVER (PARTITION BY participant, ambient) END AS d_rating FROM ratings) GROUP BY lvl", "mean_change mean_x")
def trial_trend(spark, d):
    return S.trial_trend(changed(spark, d), ["lvl"], "d_rating", "rating")


@plan(f"SELECT n, (xy - xz * yz) / sqrt(1 - xz * xz) AS r FROM (SELECT count(*) AS n, corr(rq, rt) AS xy, corr(rq, rd) AS xz, corr(rt, rd) AS yz FROM ({_RANKS}))", "r")
def partial_correlation(spark, d):
    return S.partial_correlation(D.table(spark, d, "lineitem"), "l_quantity", "l_tax", "l_discount")


_TWO = "(xy - (xz * (yz - yw * zw) + xw * (yw - yz * zw)) / (1 - zw * zw)) / sqrt(1 - (xz * xz + xw * xw - 2 * xz * xw * zw) / (1 - zw * zw))"


def _partial(x, y):
    return f"SELECT '{x}' AS x, '{y}' AS y, n, {_TWO} AS r FROM (SELECT count(*) AS n, corr({x}, {y}) AS xy, corr({x}, l_discount) AS xz, corr({x}, l_linenumber) AS xw, corr({y}, l_discount) AS yz, corr({y}, l_linenumber) AS yw, corr(l_discount, l_linenumber) AS zw FROM k)"


@plan("WITH k AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0e0 AS {c}" for c in ("l_quantity", "l_extendedprice", "l_tax", "l_discount", "l_linenumber")) + " FROM lineitem) " + " UNION ALL ".join(_partial(x, y) for x in ("l_quantity", "l_extendedprice") for y in ("l_tax",)), "r")
def partial_correlations(spark, d):
    return S.partial_correlations(D.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_tax"], ["l_discount", "l_linenumber"])


@plan("SELECT ambient, rating, ln(share / (1 - share)) AS threshold FROM (SELECT ambient, rating, sum(k) OVER (PARTITION BY ambient ORDER BY rating) * 1.0e0 / sum(k) OVER (PARTITION BY ambient) AS share FROM (SELECT ambient, rating, count(*) AS k FROM ratings GROUP BY ALL)) WHERE share < 1", "rating threshold")
def empirical_thresholds(spark, d):
    return S.empirical_thresholds(D.ratings(spark, d), "rating", ["ambient"])


@plan("SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem GROUP BY 1", "slope intercept r2", digits=4)
def simple_regression(spark, d):
    return S.simple_regression(D.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])


_ETA = "(-1 + 0.1e0 * rating + 0.05e0 * lvl)"


@plan(f"SELECT participant, ambient, lvl, 1 / (1 + exp(-{_ETA})) AS logit, exp({_ETA}) AS log, 1 - exp(-exp({_ETA})) AS cloglog, {_ETA} AS identity FROM ratings", "logit log cloglog identity")
def score_mean_model(spark, d):
    r, c = D.ratings(spark, d), {"": -1.0, "rating": 0.1, "lvl": 0.05}
    for link in ("logit", "log", "cloglog", "identity"):
        r = C.score_mean_model(r, c, link, link)
    return r.select("participant", "ambient", "lvl", "logit", "log", "cloglog", "identity")


@plan()
def score_probit(spark, d):
    return C.score_mean_model(D.ratings(spark, d), {"": -1.0, "rating": 0.1}, "probit").select("participant", "ambient", "lvl", "mu")


@plan("SELECT vec_id, CAST(i AS INT) AS i, 40 + i * 5.0e0 AS x, 1 / (1 + exp(-(CAST(embedding[1] AS DOUBLE) * 10 - 8 + (0.1e0 + CAST(embedding[2] AS DOUBLE) / 10) * (40 + i * 5.0e0)))) AS y FROM embeddings, range(0, 9) t(i)", "x y", digits=4)
def dose_response_curves(spark, d):
    p = D.table(spark, d, "embeddings").select("vec_id", (F.get("embedding", F.lit(0)).cast("double") * 10 - 8).alias("intercept"), (0.1 + F.get("embedding", F.lit(1)).cast("double") / 10).alias("slope"))
    return C.dose_response_curves(p, 40.0, 80.0, 5.0, ["vec_id"])


@plan("SELECT attitude, weight, loud, op FROM (SELECT attitude, count(*) AS weight FROM people GROUP BY 1), (VALUES (50.0e0), (60.0e0)) a(loud), (VALUES ('hover'), ('flyby')) b(op)", "loud")
def counterfactual_grid(spark, d):
    return C.counterfactual_grid(D.people(spark, d), {"loud": [50.0, 60.0], "op": ["hover", "flyby"]}, ["attitude"])


@plan()
def bootstrap_median(spark, d):
    return Q.bootstrap_ci(changed(spark, d), ["stimulus"], "rating", "median")


@plan()
def bootstrap_mean(spark, d):
    return Q.bootstrap_ci(changed(spark, d), ["stimulus"], "d_rating", "mean")


@plan("SELECT stimulus, quantile_cont(rating, 0.5) AS statistic FROM ratings GROUP BY 1", "statistic")
def grouped_statistic(spark, d):
    return Q.grouped_statistic(D.ratings(spark, d), ["stimulus"], "rating", N.weighted_median)


@plan()
def cluster_bootstrap_means(spark, d):
    return Q.cluster_bootstrap_means(D.ratings(spark, d), "participant", ["ambient", "lvl"], "rating", 100)


@plan()
def rating_outliers_hd(spark, d):
    r = D.ratings(spark, d)
    return R.rating_outliers(r, k=0.5, quartiles=Q.harrell_davis_quartiles(r, "stimulus", "rating"))


_WEIGHTED = """WITH RECURSIVE e AS (SELECT user_id AS recording, epoch_us(ts) / 1e6 AS t, (value - 20.0e0) / 1000.0e0 AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
r AS (SELECT recording, t, i, p * p AS y FROM e WHERE i = 1 UNION ALL SELECT e.recording, e.t, e.i, (1 - exp(-(e.t - r.t) / 3600)) * e.p * e.p + exp(-(e.t - r.t) / 3600) * r.y FROM r JOIN e ON e.recording = r.recording AND e.i = r.i + 1)
SELECT recording, CAST(round(t * 1e6) AS BIGINT) AS us, 10 * log10(greatest(y, 1e-30) / 4e-10) AS level FROM r"""

#: Seconds of 2,000 years.
_LATER = 5 * 146_097 * 86_400


def _event_stream(spark, d):
    """The events table, a file or a folder of files, as a stream; all of it is read in one available-now batch."""
    schema = D.table(spark, d, "events").schema
    # a stream can't read a path that is a file, but a pattern that finds one
    stream = spark.readStream.schema(schema).option("basePath", d).parquet(f"{d}/{{events.parquet}}")
    return stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("recording"), ((F.col("value") - 20.0) / 1000.0).alias("p"))


def _finished(df):
    """Runs a stream to the end of what is there, into Parquet files in the shared folder, and reads them."""
    folder = shared_folder(df.sparkSession)
    query = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


@plan("""SELECT recording, epoch_us(b) // 1000000 AS block_start, 10 * log10(avg(p * p) / 4e-10) AS leq, count(*) AS n FROM (SELECT user_id AS recording, time_bucket(INTERVAL '1 day', ts) AS b, (value - 20.0e0) / 1000.0e0 AS p FROM events)
WHERE b + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events) GROUP BY recording, b""", "leq")
def stream_block_leq(spark, d):
    # a watermark starts in 1970 and drops what is older: times are moved by whole days, and back
    later = _event_stream(spark, d).withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + _LATER * 1_000_000))
    out = _finished(monitor.stream_block_leq(later, "1 day", "1 hour"))
    return out.select("recording", (F.unix_seconds("block_start") - _LATER).alias("block_start"), "leq", "n")


@plan(_WEIGHTED, "level", digits=4)
def stream_time_weight(spark, d):
    out = _finished(monitor.stream_time_weight(_event_stream(spark, d).select("recording", (F.unix_micros("ts") / 1e6).alias("t"), "p"), 3600.0))
    return out.select("recording", F.round(F.col("t") * 1e6).cast("long").alias("us"), "level")


@plan(_WEIGHTED, "level", digits=4)
def batch_time_weight(spark, d):
    rows = D.table(spark, d, "events").select(F.col("user_id").alias("recording"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), ((F.col("value") - 20.0) / 1000.0).alias("p"))
    return monitor.batch_time_weight(rows, 3600.0).select("recording", F.round(F.col("t") * 1e6).cast("long").alias("us"), "level")
