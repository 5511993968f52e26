"""Queries on models of ratings by participants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import responses as R
from ..sources import adapters as D
from .registry import plan
from .statistics import predictions


def exposures(spark, d):
    """Order lines of a customer as trials: the rating (quantity), five measures of the sound, and whether it annoys."""
    lines = D.table(spark, d, "lineitem").join(D.table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(F.col("o_custkey").alias("participant"), F.col("l_quantity").cast("double").alias("rating"), (F.col("l_extendedprice") / 1000).alias("loudness"), "l_discount", "l_tax", (F.col("l_linenumber")).cast("double").alias("line"), (F.col("l_suppkey") % 10).cast("double").alias("source"))


@plan(digits=4)
def elastic_net_selection(spark, d):
    """Which measures predict the rating, over six folds of participants and 50 resamples."""
    rows = R.participant_folds(exposures(spark, d), "participant", 6)
    return M.elastic_net_selection(rows, "rating", ["loudness", "l_discount", "l_tax", "line", "source"], "participant", "fold")


@plan(digits=5)
def gee_exchangeable(spark, d):
    return M.gee(predictions(spark, d), "y", ["mu", "tax"], "participant").drop("z")


@plan(digits=5)
def random_intercepts(spark, d):
    return M.RandomIntercept(exposures(spark, d), "rating", ["loudness", "l_tax"], "participant").coefficients().drop("t")


@plan(digits=4)
def random_intercepts_by_participant(spark, d):
    return M.RandomIntercept(exposures(spark, d), "rating", ["loudness", "l_tax"], "participant").intercepts()


@plan(digits=4)
def cluster_influence(spark, d):
    """Mahalanobis residuals and Cook's distance of every participant in the model of gee_exchangeable."""
    return M.Marginal(predictions(spark, d), "y", ["mu", "tax"], "participant").influence()
