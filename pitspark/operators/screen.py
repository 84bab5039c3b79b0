"""Cointegration screen of candidates against a target."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import normal_cdf
from .unitroot import augmented_test

# MacKinnon's response surface for a constant, one series.
TAU_SPLIT, TAU_LOW, TAU_HIGH = -1.61, -18.83, 2.74
BELOW_SPLIT = (2.1659, 1.4412, 0.038269)
ABOVE_SPLIT = (1.7339, 0.93202, -0.12745, -0.010368)


def unit_root_z(t: Column) -> Column:
    """Normal quantile of the p-value that belongs to a Dickey-Fuller t statistic."""
    def poly(coefficients):
        value = F.lit(0.0)
        for c in reversed(coefficients):
            value = value * t + c
        return value

    return (F.when(t > TAU_HIGH, float("inf")).when(t < TAU_LOW, float("-inf"))
            .when(t <= TAU_SPLIT, poly(BELOW_SPLIT)).otherwise(poly(ABOVE_SPLIT)))


def hedge_ratio(history: DataFrame, target: str, candidates: DataFrame | None = None) -> DataFrame:
    """(k, symbol, n, slope, intercept) of candidate closes on target closes, common dates only."""
    pairs = _pairs(history, target, candidates)
    return pairs.groupBy("k", "symbol").agg(
        F.count("*").alias("n"), F.regr_slope("close", "x").alias("slope"), F.regr_intercept("close", "x").alias("intercept"))


def _pairs(history: DataFrame, target: str, candidates: DataFrame | None) -> DataFrame:
    core = history.filter(F.col("symbol") == target).select("k", "event_date", F.col("close").alias("x"))
    others = history.filter(F.col("symbol") != target)
    if candidates is not None:
        others = others.join(candidates.select("symbol").distinct(), "symbol", "left_semi")
    return others.join(core, ["k", "event_date"])


def cointegration(history: DataFrame, target: str, candidates: DataFrame | None = None,
                  p_max: float = 0.05, min_obs: int = 30, max_lag: int | None = None) -> DataFrame:
    """Residual unit-root test of every candidate on every date.

    (k, symbol, n, hedge_ratio, lag, t_stat, p_value, cointegrated, reverse, selected).
    The test regresses the residual's change on its level, a constant and the changes before;
    how many of those is chosen by AIC up to ``max_lag``, Schwert's rule where it is not given.
    A thin candidate is not selected.
    """
    paired = F.sort_array(F.collect_list(F.struct("event_date", "x", "close"))).alias("pairs")
    fitted = _pairs(history, target, candidates).groupBy("k", "symbol").agg(
        F.count("*").alias("n"), F.regr_slope("close", "x").alias("slope"), F.regr_intercept("close", "x").alias("intercept"), paired)
    enough = F.col("n") >= min_obs
    residuals = F.transform("pairs", lambda p: p["close"] - F.col("slope") * p["x"] - F.col("intercept"))
    tested = fitted.select("k", "symbol", "n", F.when(enough, F.col("slope")).alias("hedge_ratio"),
                           augmented_test(F.when(enough & F.col("slope").isNotNull(), residuals).otherwise(F.array().cast("array<double>")), max_lag).alias("test"))
    tested = tested.select("*", F.col("test.lag").alias("lag"), F.col("test.t").alias("t_stat")).drop("test")
    z = unit_root_z(F.col("t_stat"))
    fits = F.coalesce(z < NormalDist().inv_cdf(p_max), F.lit(False))
    reverse = F.coalesce(F.col("hedge_ratio") < 0, F.lit(False))
    p_value = F.when(z == float("inf"), 1.0).when(z == float("-inf"), 0.0).otherwise(normal_cdf(z))
    return tested.select(
        "k", "symbol", "n", "hedge_ratio", "lag", "t_stat", F.when(F.col("t_stat").isNotNull(), p_value).alias("p_value"),
        fits.alias("cointegrated"), reverse.alias("reverse"), (fits & reverse).alias("selected"))


def ranking(tested: DataFrame) -> DataFrame:
    """O3: the selected candidates of each date by ascending p-value (same order as the t statistic)."""
    rank = F.row_number().over(Window.partitionBy("k").orderBy("t_stat", "symbol"))
    return tested.filter("selected").withColumn("rank", rank)
