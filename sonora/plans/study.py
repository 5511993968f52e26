"""Queries on ratings, stimuli and participants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import acoustics as A
from ..operators import bands as B
from ..operators import responses as R
from ..sources import adapters as D
from ..sources import files
from .registry import plan

def base():
    return F.col("lvl") == 1


def changed(spark, d):
    return R.change_from_baseline(D.ratings(spark, d), ["participant", "ambient"], base(), ["rating"])


_CHANGE = "SELECT *, CASE WHEN lvl = 1 THEN 0 ELSE rating - max(rating) FILTER (lvl = 1) OVER (PARTITION BY participant, ambient) END AS d_rating FROM ratings"


@plan(_CHANGE, "rating d_rating")
def change_from_baseline(spark, d):
    return changed(spark, d)


_HA = """SELECT *, CASE WHEN base_ha = 0 THEN ha END AS d_ha, CASE WHEN base_p < 0.5 THEN CASE WHEN lvl = 1 THEN 0 ELSE p_ha END END AS d_p_ha FROM (
 SELECT *, max(ha) FILTER (lvl = 1) OVER w AS base_ha, max(p_ha) FILTER (lvl = 1) OVER w AS base_p FROM (
  SELECT *, CAST(rating >= 10 * 8 / 11.0e0 AS INT) AS ha, 1 / (1 + exp(-10 * (rating - 10 * 8 / 11.0e0))) AS p_ha FROM ratings) WINDOW w AS (PARTITION BY participant, ambient))"""


@plan(f"SELECT participant, ambient, lvl, stimulus, ha, p_ha, d_ha, d_p_ha FROM ({_HA})", "p_ha d_p_ha")
def change_to_highly_annoyed(spark, d):
    return R.change_to_highly_annoyed(D.ratings(spark, d), ["participant", "ambient"], base()).select("participant", "ambient", "lvl", "stimulus", "ha", "p_ha", "d_ha", "d_p_ha")


@plan(f"""WITH l AS (SELECT stimulus, 'rating' AS measure, rating AS v FROM ({_CHANGE}) UNION ALL SELECT stimulus, 'd_rating', d_rating FROM ({_CHANGE}) UNION ALL SELECT stimulus, 'ha', CAST(ha AS DOUBLE) FROM ({_HA}))
SELECT stimulus, measure, count(v) AS n, CASE WHEN measure <> 'ha' THEN quantile_cont(v, 0.5) END AS median, avg(v) AS mean, CASE WHEN measure = 'ha' THEN sum(v) END AS total, CASE WHEN measure = 'ha' THEN sum(v) / count(v) END AS proportion FROM l GROUP BY stimulus, measure""", "median mean total proportion")
def stimulus_summary(spark, d):
    df = changed(spark, d).withColumn("ha", A.highly_annoyed(F.col("rating")))
    return R.stimulus_summary(df, "stimulus", ["rating", "d_rating"], ["ha"])


@plan("""SELECT page_id, url, CASE WHEN contains(url, '#top') THEN 'Baseline' ELSE nullif(regexp_extract(url, '(example\\.(com|org|net))', 1), '') END AS host, CASE WHEN contains(url, '#top') THEN 'Baseline' ELSE nullif(regexp_extract(url, '(/en|/de|/fr|/es)', 1), '') END AS lang FROM pages""")
def extract_factors(spark, d):
    p = D.table(spark, d, "pages").select("page_id", "url")
    return R.extract_factors(p, "url", {"host": r"example\.(com|org|net)", "lang": "/en|/de|/fr|/es"}, baseline="#top")


@plan("SELECT p_partkey, CASE WHEN contains(p_type, 'STEEL') THEN 'steel' WHEN contains(p_type, 'BRASS') THEN 'brass' WHEN contains(p_type, 'E') THEN 'other' END AS label FROM part")
def classify_by_substring(spark, d):
    p = D.table(spark, d, "part").select("p_partkey", "p_type")
    return R.classify_by_substring(p, "p_type", [("E", "other"), ("BRASS", "brass"), ("STEEL", "steel")]).select("p_partkey", "label")


@plan("""SELECT page_id, CASE WHEN contains(url, '#top') THEN split_part(host, '_', 1) || '_Baseline' ELSE concat_ws('_', split_part(host, '_', 1), regexp_replace(split_part(video, 'trajectory', 1), 'Fade|_reflection|_$', '', 'g'), CAST(page_id % 3 AS VARCHAR), CAST(page_id % 5 AS VARCHAR)) END AS stim_key
FROM (SELECT page_id, url, replace(split_part(url, '/', 3), '.', '_') AS host, 'U' || CAST(page_id % 7 AS VARCHAR) || '_Fade_trajectory2' AS video FROM pages)""")
def build_stimulus_key(spark, d):
    p = D.table(spark, d, "pages").select("page_id", "url", F.regexp_replace(F.element_at(F.split("url", "/"), 3), r"\.", "_").alias("host"))
    p = p.select("*", F.concat(F.lit("U"), (F.col("page_id") % 7).cast("string"), F.lit("_Fade_trajectory2")).alias("video"), (F.col("page_id") % 3).alias("a"), (F.col("page_id") % 5).alias("b"))
    return R.build_stimulus_key(p, "host", "video", "a", "b", F.contains("url", F.lit("#top"))).select("page_id", "stim_key")


@plan("SELECT l_orderkey, l_linenumber, CAST(l_partkey % 50 AS VARCHAR) AS stim, count(*) AS n FROM lineitem GROUP BY ALL")
def strip_side(spark, d):
    x = D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat((F.col("l_partkey") % 50).cast("string"), F.when(F.col("l_linestatus") == "F", "_left").otherwise("_right")).alias("stim"))
    return R.strip_side(x, "stim").groupBy("l_orderkey", "l_linenumber", "stim").agg(F.count("*").alias("n"))


@plan("SELECT participant, CASE split_part(attitude, ' ', 1) WHEN 'BUILDING' THEN 'built' ELSE split_part(attitude, ' ', 1) END AS attitude, CAST(coalesce(age, 0) AS INT) AS age FROM people")
def fill_defaults(spark, d):
    p = D.people(spark, d).select("participant", "attitude", "age")
    p = R.fill_defaults(p, {"age": 0}, ints=["age"], first_word=["attitude"])
    return R.fill_defaults(p, {}, replace={"attitude": {"BUILDING": "built"}})


@plan("SELECT participant, CASE nation WHEN 0 THEN 'home' WHEN 1 THEN 'home' WHEN 2 THEN 'near' ELSE 'Other' END AS home, CASE attitude WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'HOUSEHOLD' THEN 3 END AS attitude_rank FROM people")
def recode_and_rank(spark, d):
    p = D.people(spark, d).withColumn("home", F.col("nation").cast("string"))
    p = R.recode_categories(p, "home", {"0": "home", "1": "home", "2": "near"}, default="Other")
    return R.ordinal_encode(p, "attitude", ["BUILDING", "MACHINERY", "HOUSEHOLD"], "attitude_rank").select("participant", "home", "attitude_rank")


@plan("SELECT r.* FROM ratings r WHERE participant NOT IN (SELECT participant FROM people WHERE age IS NULL)", "rating")
def filter_participants(spark, d):
    return R.filter_participants(D.ratings(spark, d), D.people(spark, d).filter("age IS NULL"))


@plan("SELECT participant, ambient, lvl, stimulus, trial_key, CASE WHEN lvl > 1 THEN rating END AS rating, CASE WHEN lvl = 1 THEN 'aux' ELSE 'test' END AS half FROM ratings", "rating")
def split_test_aux(spark, d):
    df = D.ratings(spark, d).withColumn("rating", F.when(F.col("lvl") > 1, F.col("rating")))
    test, aux = R.split_test_aux(df, base())
    return test.withColumn("half", F.lit("test")).unionByName(aux.withColumn("half", F.lit("aux")), allowMissingColumns=True)


@plan("SELECT l_orderkey, l_linenumber, floor(l_extendedprice / 7 * 100 + 0.5) / 100 AS up, floor(-l_discount * 10 + 0.5) / 10 AS neg FROM lineitem", "up neg")
def round_half_up(spark, d):
    x = D.table(spark, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", A.round_half_up(F.col("l_extendedprice") / 7, 2).alias("up"), A.round_half_up(-F.col("l_discount"), 1).alias("neg"))


@plan("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax / 100 < 0.001 THEN '<0.001' ELSE printf('%.3f', floor(l_tax / 100 * 1000 + 0.5) / 1000) END AS shown FROM lineitem")
def display_round(spark, d):
    return D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", A.display_round(F.col("l_tax") / 100).alias("shown"))


@plan("""SELECT l_orderkey, l_linenumber, l_partkey, x * CASE WHEN m = 0 THEN 1 ELSE sqrt(x * x + y * y) / m END AS ox, y * CASE WHEN m = 0 THEN 1 ELSE sqrt(x * x + y * y) / m END AS oy
FROM (SELECT *, greatest(abs(x), abs(y), (abs(x) + abs(y)) / sqrt(2)) AS m FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 20 - 1 AS x, l_tax * 25 - 1 AS y FROM lineitem))""", "ox oy")
def iso_circumplex(spark, d):
    ox, oy = A.iso_circumplex(F.col("l_discount") * 20 - 1, F.col("l_tax") * 25 - 1)
    return D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ox.alias("ox"), oy.alias("oy"))


@plan("SELECT participant, ambient, lvl, (rating / 10 * (n - 1) + 0.5e0) / n AS rating_beta, rating / 10 * 0.98e0 + 0.01e0 AS basic, (rating / 10 * n - 0.5e0) / (n - 1) AS back FROM ratings, (SELECT count(*) AS n FROM ratings)", "rating_beta basic back")
def beta_scale(spark, d):
    r = R.beta_scale(D.ratings(spark, d), "rating", 0.0, 10.0, "smithson")
    r = R.beta_scale(r, "rating", 0.0, 10.0, "basic", out="basic", epsilon=0.01).withColumn("share", F.col("rating") / 10)
    return R.beta_scale(r, "share", 0.0, 1.0, "smithson", "reverse", out="back").select("participant", "ambient", "lvl", "rating_beta", "basic", "back")


@plan("SELECT participant, ambient, lvl, (rating - avg(rating) OVER ()) / stddev_samp(rating) OVER () AS all_scl, (rating - avg(rating) OVER (PARTITION BY ambient)) AS rating_scl, (lvl - avg(lvl) OVER (PARTITION BY ambient)) / stddev_samp(lvl) OVER (PARTITION BY ambient) AS lvl_scl FROM ratings", "all_scl rating_scl lvl_scl")
def standardise(spark, d):
    r = R.standardise(D.ratings(spark, d), ["rating", "absent"]).withColumnRenamed("rating_scl", "all_scl")
    return R.standardise(r, ["rating", "lvl"], scale=[False, True], by=["ambient"]).select("participant", "ambient", "lvl", "all_scl", "rating_scl", "lvl_scl")


@plan("SELECT recording, channel, t_idx, band, round_even(level_db / 5, 0) * 5 AS level_class, (band + 1) / (30 / 60.0e0) AS events_per_minute FROM thirds", "level_class events_per_minute")
def bin_levels_and_rate(spark, d):
    x = R.bin_levels(D.third_octaves(spark, d), "level_db", 5.0, "level_class").withColumn("n", F.col("band") + 1).withColumn("s", F.lit(30.0))
    return R.event_rate(x, "n", "s").select("recording", "channel", "t_idx", "band", "level_class", "events_per_minute")


_STIM = "SELECT stimulus, any_value(ambient) AS ambient, any_value(lvl) AS lvl, avg(rating) AS mean, max(rating) AS top FROM ratings GROUP BY stimulus"


def stimuli(spark, d):
    return D.ratings(spark, d).groupBy("stimulus").agg(F.first("ambient").alias("ambient"), F.first("lvl").alias("lvl"), F.avg("rating").alias("mean"), F.max("rating").alias("top"))


@plan("SELECT stimulus, a.m AS mean, b.m AS mean_old FROM (SELECT stimulus, avg(rating) AS m FROM ratings GROUP BY 1) a FULL JOIN (SELECT stimulus, avg(rating) AS m FROM ratings JOIN people USING (participant) WHERE age > 60 GROUP BY 1) b USING (stimulus)", "mean mean_old")
def merge_measures(spark, d):
    r = D.ratings(spark, d)
    old = r.join(D.people(spark, d).filter("age > 60"), "participant").groupBy("stimulus").agg(F.avg("rating").alias("mean_old"))
    return R.merge_measures([r.groupBy("stimulus").agg(F.avg("rating").alias("mean")), old], "stimulus", "full_outer")


@plan(f"SELECT stimulus, r.participant, trial_key, rating, mean, attitude, age FROM ratings r FULL JOIN (SELECT stimulus, mean FROM ({_STIM}) WHERE lvl < 5) s USING (stimulus) LEFT JOIN people p ON p.participant = r.participant", "rating mean")
def join_responses_stimuli_people(spark, d):
    r = D.ratings(spark, d).select("stimulus", "participant", "trial_key", "rating")
    s = stimuli(spark, d).filter("lvl < 5").select("stimulus", "mean")
    return R.join_responses_stimuli_people(r, s, D.people(spark, d).select("participant", "attitude", "age")).select("stimulus", "participant", "trial_key", "rating", "mean", "attitude", "age")


@plan("SELECT participant, ambient, lvl, rating, level_code FROM (SELECT participant, ambient, lvl, rating FROM ratings) NATURAL JOIN (SELECT DISTINCT ambient, lvl, ambient || CAST(lvl AS VARCHAR) AS level_code FROM ratings WHERE lvl < 4)", "rating")
def natural_merge(spark, d):
    r = D.ratings(spark, d).select("participant", "ambient", "lvl", "rating")
    codes = r.filter("lvl < 4").select("ambient", "lvl").distinct().withColumn("level_code", F.concat("ambient", F.col("lvl").cast("string")))
    return R.natural_merge(r, codes).select("participant", "ambient", "lvl", "rating", "level_code")


@plan(f"""WITH s AS ({_STIM}), f AS (SELECT lvl, avg(mean) AS mean FROM s WHERE lvl > 2 GROUP BY lvl), a AS (SELECT ambient, mean FROM s WHERE lvl = 1)
SELECT stimulus, s.mean - coalesce(a.mean, 0) AS d_mean, CASE WHEN s.lvl = 1 THEN coalesce(f.mean, 0) ELSE f.mean END AS source_mean, a.mean AS ambient_mean, CASE WHEN s.lvl = 1 THEN coalesce(f.mean, 0) ELSE f.mean END - a.mean AS source_mean_less_ambient_mean FROM s LEFT JOIN f USING (lvl) LEFT JOIN a USING (ambient)""", "d_mean source_mean ambient_mean source_mean_less_ambient_mean")
def attach_components(spark, d):
    s = stimuli(spark, d)
    source = s.filter("lvl > 2").groupBy("lvl").agg(F.avg("mean").alias("mean"))
    out = R.attach_components(s, source, s.filter(base()).select("ambient", "mean"), "lvl", "ambient", ["mean"], base())
    out = R.level_differences(out, ["source_mean"], ["ambient_mean"])
    return out.select("stimulus", (F.col("mean") - F.col("ambient_mean")).alias("d_mean"), "source_mean", "ambient_mean", "source_mean_less_ambient_mean")


@plan("SELECT stim, avg_price, CAST(row_number() OVER (ORDER BY stim) AS INT) AS stim_id FROM (SELECT stim, avg(m) AS avg_price FROM (SELECT p_brand AS stim, l_linestatus, avg(l_extendedprice) AS m FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL) GROUP BY stim)", "avg_price", digits=4)
def combine_pairs(spark, d):
    x = D.table(spark, d, "lineitem").join(D.table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    sides = x.groupBy(F.concat("p_brand", F.when(F.col("l_linestatus") == "F", "_left").otherwise("_right")).alias("stim")).agg(F.avg("l_extendedprice").alias("avg_price"))
    return R.combine_pairs(sides, "stim", ["avg_price"])


_SMALL = "(SELECT participant, stimulus, rating FROM ratings WHERE participant % 10 = 0)"


@plan("SELECT p.participant, s.stimulus, rating FROM (SELECT DISTINCT participant FROM ratings) p CROSS JOIN (SELECT DISTINCT stimulus FROM ratings) s LEFT JOIN ratings r USING (participant, stimulus)", "rating")
def fill_missing_pairs(spark, d):
    return R.fill_missing_pairs(D.ratings(spark, d).select("participant", "stimulus", "rating"))


@plan(f"WITH s AS ({_STIM}) SELECT s.stimulus, s.mean, s.mean - a.mean AS d_mean, s.top - a.top AS d_top FROM s LEFT JOIN s a ON a.lvl = 1 AND a.ambient = s.ambient WHERE s.lvl <> 1", "mean d_mean d_top")
def stimulus_change(spark, d):
    return R.stimulus_change(stimuli(spark, d), "stimulus", ["mean", "top"], base()).select("stimulus", "mean", "d_mean", "d_top")


@plan("SELECT event_id, CASE WHEN value - g <= 0.5 * 1.000001 THEN g ELSE value END AS value FROM (SELECT event_id, value, (SELECT max(g) FROM (VALUES (0.0e0), (10.0e0), (20.0e0), (40.0e0), (80.0e0)) t(g) WHERE g - 0.5 * 1.000001 <= value) AS g FROM events)", "value")
def snap_to_grid(spark, d):
    return R.snap_to_grid(D.table(spark, d, "events").select("event_id", "value"), "value", [0, 10, 20, 40, 80], 0.5)


@plan("SELECT ambient, " + ", ".join(f"count(*) FILTER (rating = {v}) * 1.0e0 / count(rating) AS share_{v}" for v in range(11)) + " FROM ratings GROUP BY ambient", " ".join(f"share_{v}" for v in range(11)))
def response_shares(spark, d):
    return R.response_shares(D.ratings(spark, d), "ambient", "rating", range(11))


@plan("SELECT stimulus, age, coalesce(n, 0) AS n FROM (SELECT DISTINCT stimulus FROM ratings) CROSS JOIN (SELECT DISTINCT age FROM ratings JOIN people USING (participant) WHERE age IS NOT NULL) LEFT JOIN (SELECT stimulus, age, count(*) AS n FROM ratings JOIN people USING (participant) GROUP BY ALL) USING (stimulus, age)")
def crosstab_counts(spark, d):
    return R.crosstab_counts(D.ratings(spark, d).join(D.people(spark, d), "participant"), "stimulus", "age")


@plan("SELECT s.ambient, s.lvl, median, mean, n, base_median FROM (SELECT ambient, lvl, quantile_cont(rating, 0.5) AS median, avg(rating) AS mean, count(rating) AS n FROM ratings WHERE lvl <> 1 GROUP BY ALL) s LEFT JOIN (SELECT ambient, quantile_cont(rating, 0.5) AS base_median FROM ratings WHERE lvl = 1 GROUP BY ALL) b USING (ambient)", "median mean base_median")
def group_location(spark, d):
    return R.group_location(D.ratings(spark, d), ["ambient", "lvl"], "rating", base())


@plan("""SELECT participant, CAST(sum(CAST(rating < q1 - 0.5e0 * (q3 - q1) OR rating > q3 + 0.5e0 * (q3 - q1) AS INT)) AS BIGINT) AS n_outliers, count(rating) AS n_ratings, sum(CAST(rating < q1 - 0.5e0 * (q3 - q1) OR rating > q3 + 0.5e0 * (q3 - q1) AS INT)) * 1.0e0 / count(rating) AS share
FROM ratings JOIN (SELECT stimulus, quantile_cont(rating, 0.25) AS q1, quantile_cont(rating, 0.75) AS q3 FROM ratings GROUP BY 1) USING (stimulus) GROUP BY participant""", "share")
def rating_outliers(spark, d):
    return R.rating_outliers(D.ratings(spark, d), k=0.5)


@plan("SELECT participant, count(*) FILTER (rating < 1 AND lvl % 2 = 1) AS false_alarms, count(*) FILTER (rating > 9 AND lvl % 2 = 0) AS misses, count(*) AS n, 100.0e0 * count(*) FILTER ((rating < 1 AND lvl % 2 = 1) OR (rating > 9 AND lvl % 2 = 0)) / count(*) AS percent FROM ratings GROUP BY participant", "percent")
def notice_anomalies(spark, d):
    return R.notice_anomalies(D.ratings(spark, d).withColumn("noticed", F.col("lvl") % 2), "participant", "rating", "noticed", 1.0, 9.0)


@plan("SELECT ambient || '_' || CAST(participant AS VARCHAR) AS participant, " + ", ".join(f"max(rating) FILTER (lvl = {v}) AS \"{v}\"" for v in range(1, 8)) + " FROM ratings GROUP BY 1", " ".join(f'"{v}"' for v in range(1, 8)))
def to_wide(spark, d):
    return R.to_wide(D.ratings(spark, d).withColumn("participant", F.concat_ws("_", "ambient", "participant")), "participant", "lvl", "rating", range(1, 8))


@plan("SELECT l_orderkey, l_linenumber, l_partkey, name, value FROM (SELECT l_orderkey, l_linenumber, l_partkey, 'l_tax' AS name, l_tax AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_discount', l_discount FROM lineitem)", "value")
def to_long(spark, d):
    return R.to_long(D.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_tax", "l_discount"])


@plan("SELECT vec_id, CAST(i - 1 AS INT) AS step_idx, embedding[i] * 1.0e0 AS rating, (i - 1) * 0.1e0 AS t FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)", "rating t")
def momentary_to_long(spark, d):
    return R.momentary_to_long(D.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("series")), ["vec_id"], "series")


@plan("SELECT variable, importance, CAST(row_number() OVER (ORDER BY importance DESC, variable) AS INT) AS rank FROM (SELECT p_brand AS variable, sum(l_extendedprice) AS importance FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)", "importance", digits=2)
def rank_importance(spark, d):
    x = D.table(spark, d, "lineitem").join(D.table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return R.rank_importance(x.select(F.col("p_brand").alias("variable"), F.col("l_extendedprice").alias("importance")), 10)


@plan("SELECT participant, ambient, rating, NULL::BIGINT AS age FROM ratings UNION ALL SELECT participant, NULL, NULL, age FROM people", "rating")
def union_parts(spark, d):
    return R.union_parts(D.ratings(spark, d).select("participant", "ambient", "rating"), D.people(spark, d).select("participant", "age"))


@plan("""WITH w AS (SELECT participant, ambient, max(rating) FILTER (lvl = 1) AS s1, max(rating) FILTER (lvl = 2) AS s2 FROM ratings GROUP BY ALL)
SELECT a.participant, stimulus, rating FROM (SELECT participant, 'A' || s AS stimulus, CASE s WHEN '1' THEN s1 ELSE s2 END AS rating FROM w, (VALUES ('1'), ('2')) t(s) WHERE ambient = 'A' UNION ALL SELECT participant, 'N' || s, CASE s WHEN '1' THEN s1 ELSE s2 END FROM w, (VALUES ('1'), ('2')) t(s) WHERE ambient = 'N') a
WHERE participant IN (SELECT participant FROM w WHERE ambient = 'A') AND participant IN (SELECT participant FROM w WHERE ambient = 'N')""", "rating")
def transpose_ratings(spark, d):
    def wide(ambient):
        w = R.to_wide(D.ratings(spark, d).filter(F.col("ambient") == ambient), "participant", "lvl", "rating", [1, 2])
        return w.select("participant", F.col("1").alias(f"{ambient}1"), F.col("2").alias(f"{ambient}2"))

    return R.transpose_ratings(wide("A"), wide("N"), "participant", ["A1", "A2"], ["N1", "N2"])


@plan("SELECT participant, nation, coalesce(age, m) AS age, age IS NULL AS age_missing FROM people, (SELECT quantile_cont(age, 0.5) AS m FROM people) WHERE participant IN (SELECT participant FROM ratings)", "age")
def impute_median(spark, d):
    first = R.first_per_participant(D.ratings(spark, d).select("participant").join(D.people(spark, d), "participant", "left"), "participant", ["nation"])
    people = R.impute_median(D.people(spark, d).select("participant", "age"), "age")
    return people.join(first, "participant").select("participant", "nation", "age", "age_missing")


@plan("SELECT participant, trial, overall FROM (SELECT participant, lvl AS trial, lvl AS overall FROM ratings WHERE ambient = 'A' UNION ALL SELECT r.participant, lvl, lvl + coalesce(CASE WHEN r.participant = 7 THEN 3 END, last, 0) FROM ratings r LEFT JOIN (SELECT participant, max(lvl) AS last FROM ratings WHERE ambient = 'A' GROUP BY 1) a ON a.participant = r.participant WHERE ambient = 'N')")
def trial_numbering(spark, d):
    part = lambda a: D.ratings(spark, d).filter(F.col("ambient") == a).select("participant", F.col("lvl").cast("long").alias("trial"))
    return R.trial_numbering(part("A"), part("N"), overrides={7: 3})


@plan("SELECT p.participant, f.n > 0 AS same, n_folds FROM (SELECT DISTINCT participant FROM ratings) p, (SELECT 1 AS n, 6 AS n_folds) f")
def participant_folds(spark, d):
    x = R.participant_folds(D.ratings(spark, d), "participant", 6)
    sizes = x.select("participant", "fold").distinct().groupBy("fold").agg(F.count("*").alias("n"))
    even = sizes.agg(F.count("*").cast("int").alias("n_folds"), (F.max("n") - F.min("n") <= 1).alias("even"))
    one = x.groupBy("participant").agg((F.countDistinct("fold") == 1).alias("one"))
    return one.join(F.broadcast(even)).select("participant", (F.col("one") & F.col("even")).alias("same"), "n_folds")


@plan("SELECT page_id, nullif(regexp_replace(split_part(regexp_replace(url, '[?#].*$', ''), '/', -1), '\\.[^.]*$', ''), '') AS stem, nullif(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '') AS rendering, nullif(regexp_extract(url, '/(en|de|fr|es)/', 1), '') AS kind FROM pages")
def parse_file_facets(spark, d):
    return files.parse_file_facets(D.table(spark, d, "pages").select("page_id", "url"), "url").drop("url")


@plan("SELECT recording, CAST(i AS INT) AS band, f AS f_mid, f / pow(10, 0.05e0) AS f_low, f * pow(10, 0.05e0) AS f_high, nominal AS f_nominal FROM (SELECT DISTINCT recording FROM thirds), (SELECT i, 1000 * pow(10, 0.3e0 * (i - 17) / 3) AS f, CAST(list_value(20, 25, 31.5, 40, 50, 63, 80, 100, 125, 160, 200, 250, 315, 400, 500, 630, 800, 1000, 1250, 1600, 2000, 2500, 3150, 4000, 5000, 6300, 8000, 10000, 12500, 16000, 20000)[i + 1] AS DOUBLE) AS nominal FROM range(0, 31) t(i))", "f_mid f_low f_high f_nominal")
def nominal_bands(spark, d):
    own = D.third_octaves(spark, d).select("recording", "band").distinct()
    return own.join(F.broadcast(B.nominal_bands(spark, 20, 20000)), "band").select("recording", "band", "f_mid", "f_low", "f_high", "f_nominal")
