"""Scores of fitted models, dose-response curves and counterfactual grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..runtime import ship_package


def inverse_link(eta: Column, link: str) -> Column:
    if link == "logit":
        return 1 / (1 + F.exp(-eta))
    if link == "log":
        return F.exp(eta)
    if link == "cloglog":
        return 1 - F.exp(-F.exp(eta))
    if link == "identity":
        return eta
    if link == "probit":

        @F.pandas_udf("double")
        def cdf(x: pd.Series) -> pd.Series:
            return pd.Series(N.normal_cdf(x.to_numpy()))

        return cdf(eta)
    raise ValueError(link)


def score_mean_model(df: DataFrame, coefficients: Mapping[str, float], link: str, out: str = "mu") -> DataFrame:
    """Mean prediction of a linear predictor ("" is the intercept)."""
    if link == "probit":
        ship_package(df.sparkSession)
    eta = F.lit(float(coefficients.get("", 0.0)))
    for name, c in coefficients.items():
        if name:
            eta = eta + F.col(name) * c
    return df.withColumn(out, inverse_link(eta, link))


def dose_response_curves(params: DataFrame, low: float, high: float, step: float, keys: Sequence[str]) -> DataFrame:
    """Logistic curves (intercept, slope) of each parameter row on a grid of exposures; the grid is of fixed size."""
    n = round((high - low) / step)
    rows = params.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("x", low + F.col("i") * step)
    return rows.select(*keys, "i", "x", inverse_link(F.col("intercept") + F.col("slope") * F.col("x"), "logit").alias("y"))


def counterfactual_grid(base: DataFrame, variables: Mapping[str, Sequence], weights: Sequence[str] = ()) -> DataFrame:
    """Every base row under every combination of overwritten values (few, fixed); with `weights`, base rows are first counted by these factors."""
    out = base.groupBy(*weights).agg(F.count("*").alias("weight")) if weights else base
    for name, values in variables.items():
        out = out.drop(name).withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out
