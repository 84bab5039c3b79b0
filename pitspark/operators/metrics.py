"""Wealth paths, risk metrics and distribution statistics of return tables.

A return table is (run, k, ret), one row per run and date. Windows partition by
run, so one partition never holds more than a calendar.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calendars import Calendar, WalkForward, constant_array, segments


def _path(by: list[str], order: str) -> Window:
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def wealth_path(returns: DataFrame, by: list[str], order: str = "k") -> DataFrame:
    """W2 + W3: wealth and drawdown; the peak starts at the first wealth, not at one."""
    path = _path(by, order)
    out = returns.withColumn("wealth", F.product(1.0 + F.col("ret")).over(path))
    out = out.withColumn("peak", F.max("wealth").over(path))
    down = F.when(F.col("peak") == 0, -1.0).otherwise(F.col("wealth") / F.col("peak") - 1.0)
    return out.withColumn("drawdown", down).drop("peak")


def rolling_sharpe(returns: DataFrame, by: list[str], window: int, periods_per_year: float,
                   order: str = "k") -> DataFrame:
    """Full frames only; a series shorter than the window uses its own length."""
    whole = Window.partitionBy(*by)
    size = F.greatest(F.lit(2), F.least(F.lit(window), F.count("*").over(whole)))
    ranked = returns.withColumn("rank", F.row_number().over(whole.orderBy(order))).withColumn("size", size)
    frame = whole.orderBy(order).rowsBetween(-(window - 1), 0)
    mean, std = F.avg("ret").over(frame), F.stddev_pop("ret").over(frame)
    value = F.when(std > 1e-12, mean / std * math.sqrt(periods_per_year)).otherwise(0.0)
    return ranked.withColumn("rolling_sharpe", value).filter("rank >= size").drop("rank", "size")


def by_segment(returns: DataFrame, calendar: Calendar, plan: WalkForward | None) -> DataFrame:
    """A3: repeat each row once per segment its date belongs to."""
    member = [F.when(F.array_contains(constant_array(ks, "int"), F.col("k")), F.lit(name)) for name, ks in segments(calendar, plan).items() if ks]
    return returns.withColumn("segment", F.explode(F.filter(F.array(*member), lambda s: s.isNotNull())))


def performance(returns: DataFrame, periods_per_year: float, by: list[str]) -> DataFrame:
    """A1: the metric record of each group; expects ``ret`` (null = no return) and ``turnover``.

    A date without a return leaves the running product as it was, so returns and
    turnovers share one pass; a group without any return has no record.
    """
    path = wealth_path(returns, by)
    stats = path.groupBy(*by).agg(
        F.count("ret").alias("periods"), F.avg("ret").alias("mean"),
        F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("std"),
        F.max_by("wealth", "k").alias("final"), F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
        F.sum("turnover").alias("turnover"))
    root = math.sqrt(periods_per_year)
    annual = F.when(F.col("final") <= 0, -1.0).otherwise(F.pow("final", F.lit(periods_per_year) / F.col("periods")) - 1.0)
    return stats.filter("periods > 0").select(
        *by, "periods", (F.col("final") - 1.0).alias("cumulative_return"), annual.alias("annualized_return"),
        (F.col("std") * root).alias("annualized_vol"), "max_drawdown",
        F.when(F.col("std") > 0, F.col("mean") / F.col("std") * root).otherwise(0.0).alias("sharpe"),
        "turnover")


def distribution(returns: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """Population moments and the 5 % value at risk, with any further aggregates of the caller."""
    return returns.groupBy(*by).agg(
        F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("volatility"),
        F.skewness("ret").alias("skew"), F.kurtosis("ret").alias("excess_kurtosis"),
        (-F.percentile("ret", F.lit(0.05))).alias("var_5pct"), F.count("*").alias("observations"), *more)


def population_sharpe(periods_per_year: float) -> Column:
    """The research Sharpe: population deviation, unlike A1."""
    std = F.stddev_pop("ret")
    return F.when(std > 1e-12, F.avg("ret") / std * math.sqrt(periods_per_year)).otherwise(0.0)


def returns_from_equity(equity: DataFrame, by: list[str], first_base: float | None = None) -> DataFrame:
    """(equity_t / equity_t-1) - 1. With a first base the first point counts too."""
    order = Window.partitionBy(*by).orderBy("k")
    if first_base is None:
        out = equity.withColumn("before", F.lag("equity").over(order)).filter("before is not null")
    else:
        out = equity.withColumn("before", F.lag("equity", 1, first_base).over(order))
    ret = F.when(F.col("before") != 0, F.col("equity") / F.col("before") - 1.0).otherwise(0.0)
    return out.withColumn("ret", ret).drop("before")


def histogram(returns: DataFrame, by: list[str], bins: int = 16) -> DataFrame:
    """Counts of equal bins over [min, max]; the last bin is closed."""
    extent = returns.groupBy(*by).agg(F.min("ret").alias("lo"), F.max("ret").alias("hi"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    placed = returns.join(extent, by).withColumn(
        "bin", F.least(F.lit(bins - 1), F.floor((F.col("ret") - F.col("lo")) / span * bins).cast("int")))
    return placed.groupBy(*by, "bin").agg(F.count("*").alias("n"))


def growth(equity: DataFrame, by: list[str], periods_per_year: float) -> DataFrame:
    """Compound growth of an equity path and its worst drawdown."""
    out = equity.groupBy(*by).agg(
        F.max_by("equity", "k").alias("final"), F.count("*").alias("n"), F.min("drawdown").alias("max_drawdown"))
    cagr = F.when(F.col("final") <= 0, -1.0).otherwise(F.pow("final", F.lit(periods_per_year) / F.col("n")) - 1.0)
    return out.select(*by, cagr.alias("cagr"), "max_drawdown")


def flat_guard(metrics: DataFrame, by: list[str] | None = None, eps: float = 1e-6) -> DataFrame:
    """Whether any strategy moved out of sample at all."""
    oos = metrics.filter("segment = 'out_of_sample'").groupBy(*(by or [])).agg(F.max("annualized_vol").alias("max_oos_vol"))
    return oos.withColumn("status", F.when(F.col("max_oos_vol") < eps, "degenerate").otherwise("computed"))
