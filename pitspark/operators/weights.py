"""Strategies: queries that return (run, k, symbol, weight) for every date at once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import regime, uniform
from ..session import local_table
from .asof import BY_PERIOD, history_asof, latest_asof
from .calendars import Calendar

COLUMNS = ("run", "k", "symbol", "weight")


def _every_date(frame: DataFrame, calendar: Calendar) -> DataFrame:
    return frame.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(calendar) - 1))))


def _named(frame: DataFrame, run: str) -> DataFrame:
    return frame.withColumn("run", F.lit(run)).select(*COLUMNS)


def normalise(frame: DataFrame, by: list[str], when_empty: str = "equal", weight: str = "weight") -> DataFrame:
    """Clip at zero and scale each group to one; an all-zero group turns equal or zero.

    The totals come from an aggregation, which combines map-side, rather than a
    window that would sort a whole group in one task.
    """
    clipped = frame.withColumn(weight, F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0)))
    totals = clipped.groupBy(*by).agg(F.sum(weight).alias("_total"), F.count("*").alias("_n"))
    empty = 1.0 / F.col("_n") if when_empty == "equal" else F.lit(0.0)
    scaled = F.when(F.col("_total") > 0, F.col(weight) / F.col("_total")).otherwise(empty)
    return clipped.join(totals, by).withColumn(weight, scaled).drop("_total", "_n")


def equal_weight(symbols: DataFrame, calendar: Calendar, run: str = "equal_weight") -> DataFrame:
    """M1"""
    n = symbols.select("symbol").distinct().agg(F.count("*")).scalar()
    return _named(_every_date(symbols.select("symbol").distinct(), calendar).withColumn("weight", 1.0 / n), run)


def static_weights(weights: DataFrame, calendar: Calendar, run: str = "static") -> DataFrame:
    """M2: fixed (symbol, weight), normalised; a zero total stays all cash."""
    total = weights.agg(F.sum(F.greatest("weight", F.lit(0.0)))).scalar()
    share = F.when(total > 0, F.greatest("weight", F.lit(0.0)) / total).otherwise(0.0)
    return _named(_every_date(weights.select("symbol", share.alias("weight")), calendar), run)


def random_weights(symbols: DataFrame, calendar: Calendar, seed: int = 0, run: str = "random") -> DataFrame:
    """M3: uniform draws from a hash of (seed, date, symbol), scaled to one per date."""
    drawn = _every_date(symbols.select("symbol").distinct(), calendar)
    day = F.date_format(calendar.as_of(F.col("k")), "yyyy-MM-dd")
    drawn = drawn.withColumn("weight", uniform(seed, day, F.col("symbol")))
    return _named(normalise(drawn, ["k"], when_empty="zero"), run)


def sma_timing(prices: DataFrame, symbols: DataFrame, calendar: Calendar, window: int = 10,
               run: str = "sma_timing") -> DataFrame:
    """Invested while the last close stands above its moving average.

    Too little history counts as invested, none at all as cash.
    """
    if window < 2:
        raise ValueError("a moving average needs a window of at least 2")
    recent = history_asof(prices, calendar, last=window)
    state = recent.groupBy("symbol", "k").agg(
        F.count("*").alias("n"), F.avg("close").alias("mean"), F.max_by("close", "event_date").alias("last"))
    grid = _every_date(symbols.select("symbol").distinct(), calendar)
    weight = F.when(F.col("n").isNull(), 0.0).when(F.col("n") < window, 1.0).when(F.col("last") > F.col("mean"), 1.0).otherwise(0.0)
    return _named(grid.join(state, ["symbol", "k"], "left").withColumn("weight", weight), run)


def trend(prices: DataFrame, calendar: Calendar, lookback: int = 12) -> DataFrame:
    """(symbol, k, trend) over lookback + 1 closes; short or non-positive start gives null."""
    ends = history_asof(prices, calendar, last=lookback + 1).groupBy("symbol", "k").agg(
        F.count("*").alias("n"), F.min_by("close", "event_date").alias("first"), F.max_by("close", "event_date").alias("last"))
    rise = F.when((F.col("n") == lookback + 1) & (F.col("first") > 0), F.col("last") / F.col("first") - 1.0)
    return ends.select("symbol", "k", rise.alias("trend"))


def regime_labels(prices: DataFrame, macro: DataFrame, calendar: Calendar, price_symbol: str,
                  curve_series: str, lookback: int = 12, threshold: float = 0.0) -> DataFrame:
    """F10 for every date: (k, as_of, trend, curve, label, confidence)."""
    rise = trend(prices.filter(F.col("symbol") == price_symbol), calendar, lookback).select("k", "trend")
    curve = latest_asof(macro.filter(F.col("series") == curve_series), calendar, "series", BY_PERIOD, "value")
    dates = calendar.frame(prices.sparkSession).select("k", "as_of")
    both = dates.join(rise, "k", "left").join(curve.select("k", F.col("value").alias("curve")), "k", "left")
    return both.select("k", "as_of", "trend", "curve", regime(F.col("trend"), F.col("curve"), threshold).alias("s")).select(
        "k", "as_of", "trend", "curve", "s.label", "s.confidence")


def regime_allocation(labels: DataFrame, by_label: Mapping[str, Mapping[str, float]], run: str = "regime") -> DataFrame:
    """M6: the weights that go with each date's label; ``unknown`` falls back to ``risk_on``."""
    books = dict(by_label)
    books.setdefault("unknown", books["risk_on"])
    rows = [(label, s, float(w)) for label, book in books.items() for s, w in book.items()]
    table = local_table(labels.sparkSession, rows, "label string, symbol string, weight double")
    return _named(labels.join(F.broadcast(normalise(table, ["label"])), "label"), run)


def hedge_weights(selected: DataFrame, calendar: Calendar, target: str, fraction: float = 0.3,
                  run: str = "hedge") -> DataFrame:
    """Target core plus the selected (k, symbol) sharing the hedge fraction."""
    f = min(1.0, max(0.0, float(fraction)))
    legs = selected.select("k", "symbol").distinct()
    counts = legs.groupBy("k").agg(F.count("*").alias("n"))
    core = (calendar.frame(selected.sparkSession).select("k").join(counts, "k", "left")
            .select("k", F.lit(target).alias("symbol"), F.when(F.col("n") > 0, 1.0 - f).otherwise(1.0).alias("weight")))
    hedge = legs.join(counts, "k").select("k", "symbol", (F.lit(f) / F.col("n")).alias("weight"))
    both = core.unionByName(hedge).groupBy("k", "symbol").agg(F.sum("weight").alias("weight"))
    return _named(normalise(both, ["k"], when_empty="zero"), run)


def forecast_weights(forecasts: DataFrame, run: str = "learned_forecast") -> DataFrame:
    """Positive forecasts share the portfolio; a degraded date, or none positive, is equal weight."""
    sound = forecasts.groupBy("k").agg(F.bool_and(F.col("status") == "ok").alias("sound"))
    raw = forecasts.join(sound, "k").withColumn("weight", F.when(F.col("sound"), F.col("expected_return")).otherwise(0.0))
    return _named(normalise(raw, ["k"]), run)
