"""Model against baseline, several runs through one backtest."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import allocation, moments, screen
from ..operators import weights as w
from ..operators.asof import history_asof
from ..operators.backtest import Backtest, Costs, run_backtest
from ..operators.calendars import Calendar, WalkForward, on_change_or_due
from ..session import local_table, materialise
from .runs import leaderboard, records

CLAIMED = {"claim_boundary": "no_alpha_claim"}


def hedge_slice(prices: DataFrame, config: Backtest, *, target: str, hedge_fraction: float = 0.3,
                p_max: float = 0.05, seed: int = 0) -> DataFrame:
    """Hedge, buy and hold, equal and random weights on one universe."""
    calendar = config.calendar
    names = prices.select("symbol").distinct()
    history = history_asof(prices, calendar)
    chosen = materialise(screen.cointegration(history, target, p_max=p_max).filter("selected"), "selected")
    core = local_table(prices.sparkSession, [(target,)], "symbol string")
    table = (w.hedge_weights(chosen, calendar, target, hedge_fraction)
             .unionByName(w.equal_weight(core, calendar, "buy_and_hold"))
             .unionByName(w.equal_weight(names, calendar))
             .unionByName(w.random_weights(names, calendar, seed)))
    about = {"hedge": {}, "buy_and_hold": {}, "equal_weight": {}, "random": {}}
    return leaderboard(records(table, prices, config, about, ["buy_and_hold", "equal_weight", "random"]))


def _enough(calendar: Calendar, what: str) -> None:
    if len(calendar) < 12:
        raise ValueError(f"{what}: fewer than a year of monthly dates")


def regime_benchmark(prices: DataFrame, macro: DataFrame, candidates: Calendar, *, risk_symbol: str, defensive_symbol: str,
                     curve_series: str, lookback: int, books: Mapping[str, Mapping[str, float]],
                     frequency: str = "quarterly") -> DataFrame:
    """Labels per date, rebalanced when due or changed, against half and half."""
    _enough(candidates, "the regime benchmark")
    spark = prices.sparkSession
    labels = w.regime_labels(prices, macro, candidates, risk_symbol, curve_series, lookback).select("as_of", "label")
    chosen = on_change_or_due(labels, frequency)
    # a calendar decides the plan of everything after it, so it comes to the driver
    label_of = {row["as_of"]: row["label"] for row in chosen.collect()}
    calendar = Calendar.of(label_of)
    labelled = local_table(spark, [(k, label_of[d]) for k, d in enumerate(calendar.dates)], "k int, label string")
    half = local_table(spark, [(risk_symbol, 0.5), (defensive_symbol, 0.5)], "symbol string, weight double")
    table = w.regime_allocation(labelled, books).unionByName(w.static_weights(half, calendar, "baseline"))
    config = Backtest(calendar, "monthly", "net", Costs(commission_bps=5), WalkForward(6, 6, 6))
    runs = local_table(spark, [("regime",), ("baseline",)], "run string")
    return run_backtest(table, prices, config, runs)[1]


def _against_equal(table: DataFrame, prices: DataFrame, config: Backtest, symbols: list[str], run: str) -> DataFrame:
    names = local_table(prices.sparkSession, [(s,) for s in symbols], "symbol string")
    both = table.unionByName(w.equal_weight(names, config.calendar, "baseline"))
    return leaderboard(records(both, prices, config, {run: CLAIMED, "baseline": {}}, ["baseline"]))


def _default(config: Backtest) -> Backtest:
    return replace(config, mode="net", costs=Costs(commission_bps=5), walk_forward=WalkForward(36, 12, 12))


def return_risk_benchmark(prices: DataFrame, config: Backtest, symbols: list[str], vol_cap: float = 0.30) -> DataFrame:
    """Forecast allocation against equal weight."""
    _enough(config.calendar, "the return/risk benchmark")
    names = local_table(prices.sparkSession, [(s,) for s in symbols], "symbol string")
    table = allocation.diagonal_allocation(moments.return_risk(prices, names, config.calendar), symbols, vol_cap)
    return _against_equal(table, prices, _default(config), symbols, "forecast_allocation")


def robust_benchmark(prices: DataFrame, config: Backtest, symbols: list[str], vol_cap: float = 0.30) -> DataFrame:
    """Downside-penalised allocation against equal weight."""
    _enough(config.calendar, "the robust benchmark")
    names = local_table(prices.sparkSession, [(s,) for s in symbols], "symbol string")
    estimates = moments.downside_risk(prices, names, config.calendar)
    table = allocation.diagonal_allocation(estimates, symbols, vol_cap, mean="adjusted_return", run="robust_allocation")
    return _against_equal(table, prices, _default(config), symbols, "robust_allocation")


def learned_benchmark(table: DataFrame, prices: DataFrame, config: Backtest, symbols: list[str]) -> DataFrame:
    """Learned forecast weights against equal weight."""
    _enough(config.calendar, "the learned forecast benchmark")
    return _against_equal(table, prices, _default(config), symbols, "learned_forecast")
