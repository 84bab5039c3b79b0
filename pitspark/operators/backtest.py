"""Portfolio returns from a table of weights.

A strategy is a query that returns (run, k, symbol, weight). The return of date k
needs only its own weights, those of k-1 and two as-of prices, so a backtest is
joins and windows; any number of runs share one pass over the prices.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import trading_cost
from .asof import price_legs
from .calendars import PERIODS_PER_YEAR, Calendar, WalkForward
from .metrics import by_segment, performance


@dataclass(frozen=True)
class Costs:
    """Basis points charged on turnover; withholding and currency spread are carried, not charged."""

    commission_bps: float = 0.0
    slippage_bps: float = 0.0
    tw_transaction_tax_bps: float = 0.0
    us_dividend_withholding_pct: float = 0.0
    fx_spread_bps: float = 0.0

    @property
    def charged_bps(self) -> float:
        return self.commission_bps + self.slippage_bps + self.tw_transaction_tax_bps


@dataclass(frozen=True)
class Backtest:
    calendar: Calendar
    rebalance: str = "monthly"
    mode: str = "net"
    costs: Costs = field(default_factory=Costs)
    walk_forward: WalkForward | None = None

    @property
    def periods_per_year(self) -> float:
        return PERIODS_PER_YEAR[self.rebalance]


def turnover_parts(weights: DataFrame, n_dates: int) -> DataFrame:
    """(run, k, turnover) pieces that sum to the absolute change of weights.

    A weight that is absent counts as zero, so a held symbol that disappears adds
    its whole weight on the date after.
    """
    order = Window.partitionBy("run", "symbol").orderBy("k")
    near = weights.select(
        "run", "k", "weight", F.lag("k").over(order).alias("k0"), F.lag("weight").over(order).alias("w0"),
        F.lead("k").over(order).alias("k1"))
    held = F.when(F.col("k0") == F.col("k") - 1, F.col("w0")).otherwise(0.0)
    arrive = F.struct(F.col("k").alias("k"), F.abs(F.col("weight") - held).alias("turnover"))
    leave = F.when((F.col("k") < n_dates - 1) & (F.coalesce(F.col("k1"), F.lit(-1)) != F.col("k") + 1),
                   F.struct((F.col("k") + 1).alias("k"), F.abs("weight").alias("turnover")))
    pieces = near.select("run", F.explode(F.filter(F.array(arrive, leave), lambda p: p.isNotNull())).alias("p"))
    return pieces.select("run", "p.k", "p.turnover")


def on_legs(weights: DataFrame, legs: DataFrame) -> DataFrame:
    """Weights with the legs they earn.

    Weights unfold over the dates from few symbols, so Spark's size check would take them for
    small and broadcast every cell.
    """
    return weights.hint("merge").join(legs.filter("leg is not null"), ["symbol", "k"])


def portfolio_returns(weights: DataFrame, legs: DataFrame, n_dates: int,
                      cost_bps: float | Column = 0.0, runs: DataFrame | None = None) -> DataFrame:
    """A2: (run, k, gross, turnover, ret) for every run and date.

    ``gross`` and ``ret`` are null on the last date, which has a turnover only.
    Dates without weights or without priced legs still get a row.
    """
    earned = (on_legs(weights, legs)
              .select("run", "k", (F.col("weight") * F.col("leg")).alias("gross"), F.lit(0.0).alias("turnover")))
    traded = turnover_parts(weights, n_dates).select("run", "k", F.lit(0.0).alias("gross"), "turnover")
    named = runs if runs is not None else weights.select("run").distinct()
    grid = named.select("run", F.explode(F.sequence(F.lit(0), F.lit(n_dates - 1))).alias("k"),
                        F.lit(0.0).alias("gross"), F.lit(0.0).alias("turnover"))
    daily = grid.unionByName(earned).unionByName(traded).groupBy("run", "k").agg(
        F.sum("gross").alias("gross"), F.sum("turnover").alias("turnover"))
    gross = F.when(F.col("k") < n_dates - 1, F.col("gross"))
    cost = trading_cost(F.col("turnover"), F.lit(cost_bps) if not isinstance(cost_bps, Column) else cost_bps)
    return daily.select("run", "k", gross.alias("gross"), "turnover", (gross - cost).alias("ret"))


def run_backtest(weights: DataFrame, prices: DataFrame, config: Backtest,
                 runs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """B1: (returns, metrics) of every run in the weights table."""
    bps = config.costs.charged_bps if config.mode == "net" else 0.0
    legs = price_legs(prices, config.calendar)
    returns = portfolio_returns(weights, legs, len(config.calendar), bps, runs)
    metrics = performance(by_segment(returns, config.calendar, config.walk_forward),
                          config.periods_per_year, ["run", "segment"])
    dated = returns.withColumn("as_of", config.calendar.as_of(F.col("k")))
    return dated, metrics.withColumn("basis", F.lit(config.mode))


def realised_returns(weights: DataFrame, history: DataFrame, commission_bps: float, n_dates: int) -> DataFrame:
    """(run, k, ret) for k >= 1, the weights of k-1 held to k.

    Here a price is the newest event date of the visible history, not the newest
    release, and ``history`` must already be without missing values.
    """
    close = history.groupBy("symbol", "k").agg(F.max_by("close", "event_date").alias("close"))
    order = Window.partitionBy("symbol").orderBy("k")
    moves = close.select("symbol", "k", "close", F.lead("k").over(order).alias("k1"), F.lead("close").over(order).alias("after"))
    leg = F.when((F.col("k1") == F.col("k") + 1) & (F.col("close") > 0), F.col("after") / F.col("close") - 1.0)
    legs = moves.select("symbol", "k", leg.alias("leg"))
    held = portfolio_returns(weights, legs, n_dates, commission_bps)
    return held.filter("ret is not null").select("run", (F.col("k") + 1).alias("k"), "ret")
