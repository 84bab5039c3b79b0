import math
import random
from datetime import datetime

import pandas as pd
import pytest

from pitspark.operators import metrics
from pitspark.operators import weights as w
from pitspark.operators.backtest import Backtest, Costs, portfolio_returns, run_backtest, turnover_parts
from pitspark.operators.calendars import Calendar, WalkForward
from pitspark.schemas import PRICES


def ts(text):
    return datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def toy(spark):
    closes = [("2020-01-31", 100.0), ("2020-02-29", 110.0), ("2020-03-31", 121.0)]
    prices = spark.createDataFrame([("X", ts(d), ts(d), c, False) for d, c in closes], PRICES)
    return prices, Calendar.between("2020-01-01", "2020-03-31")


def one(frame, **where):
    rows = [r for r in frame.collect() if all(r[k] == v for k, v in where.items())]
    assert len(rows) == 1
    return rows[0]


def test_toy_run_by_hand(spark, toy):
    prices, days = toy
    table = w.equal_weight(prices.select("symbol"), days, "bh")
    _, m = run_backtest(table, prices, Backtest(days, mode="gross", walk_forward=WalkForward(1, 1, 1)))
    full = one(m, segment="full")
    assert full["cumulative_return"] == pytest.approx(0.21, abs=1e-12)
    assert full["annualized_vol"] == pytest.approx(0.0, abs=1e-12)
    assert full["max_drawdown"] == 0.0
    assert full["turnover"] == 1.0
    assert full["annualized_return"] == pytest.approx(1.21 ** 6 - 1, rel=1e-12)
    assert {r["segment"] for r in m.collect()} == {"full", "in_sample", "out_of_sample"}


def test_costs_hit_the_rebalance_that_trades(spark, toy):
    prices, days = toy
    table = w.equal_weight(prices.select("symbol"), days, "bh")
    costs = Costs(commission_bps=10, slippage_bps=5, tw_transaction_tax_bps=30, fx_spread_bps=99)
    returns, m = run_backtest(table, prices, Backtest(days, costs=costs))
    got = {r["k"]: r["ret"] for r in returns.collect()}
    assert got[0] == pytest.approx(0.1 - 0.0045, abs=1e-12) and got[1] == pytest.approx(0.1, abs=1e-12) and got[2] is None
    free, _ = run_backtest(table, prices, Backtest(days, mode="net"))
    gross, _ = run_backtest(table, prices, Backtest(days, mode="gross"))
    assert free.collect() == gross.collect()


def test_turnover_counts_arrivals_changes_and_departures(spark):
    rows = [("r", 0, "A", 0.5), ("r", 0, "B", 0.5), ("r", 1, "A", 1.0), ("r", 3, "A", 0.25)]
    table = spark.createDataFrame(rows, "run string, k int, symbol string, weight double")
    total = {r["k"]: 0.0 for r in turnover_parts(table, 5).collect()}
    for r in turnover_parts(table, 5).collect():
        total[r["k"]] += r["turnover"]
    assert total == {0: 1.0, 1: 1.0, 2: 1.0, 3: 0.25, 4: 0.25}


def test_all_cash_dates_still_have_a_return(spark, toy):
    prices, days = toy
    table = spark.createDataFrame([("r", 0, "X", 1.0)], "run string, k int, symbol string, weight double")
    from pitspark.operators.asof import price_legs
    rows = {r["k"]: (r["gross"], r["turnover"], r["ret"]) for r in portfolio_returns(table, price_legs(prices, days), 3, 100.0).collect()}
    assert rows[1] == (0.0, 1.0, pytest.approx(-0.01))
    assert rows[2][0] is None and rows[2][1] == 0.0


def reference_metrics(rets, ppy):
    """The metric record straight from its definition."""
    wealth, path = 1.0, []
    for r in rets:
        wealth *= 1 + r
        path.append(wealth)
    peak, worst = -math.inf, 0.0
    for v in path:
        peak = max(peak, v)
        worst = min(worst, -1.0 if peak == 0 else v / peak - 1)
    s = pd.Series(rets)
    std = float(s.std(ddof=1)) if len(rets) > 1 else 0.0
    return {"cumulative_return": path[-1] - 1, "annualized_return": -1.0 if path[-1] <= 0 else path[-1] ** (ppy / len(rets)) - 1,
            "annualized_vol": std * ppy ** 0.5, "max_drawdown": worst, "sharpe": s.mean() / std * ppy ** 0.5 if std > 0 else 0.0}


def test_metrics_match_their_definition(spark):
    draw = random.Random(5)
    series = {f"r{i}": [draw.uniform(-0.3, 0.4) for _ in range(n)] for i, n in enumerate([1, 2, 7, 40])}
    series["ruin"] = [0.1, -1.0, 0.2]
    series["first_loss"] = [-0.5, 0.1]
    rows = [(run, "full", k, v, 0.5) for run, rets in series.items() for k, v in enumerate(rets)]
    rows += [(run, "full", len(rets), None, 0.5) for run, rets in series.items()]
    got = metrics.performance(spark.createDataFrame(rows, "run string, segment string, k int, ret double, turnover double"), 12.0, ["run", "segment"])
    for row in got.collect():
        rets = series[row["run"]]
        for name, want in reference_metrics(rets, 12.0).items():
            assert row[name] == pytest.approx(want, abs=1e-12), (row["run"], name)
        assert row["periods"] == len(rets) and row["turnover"] == 0.5 * (len(rets) + 1)
    first = [r for r in got.collect() if r["run"] == "first_loss"][0]
    assert first["max_drawdown"] == 0.0


def test_rolling_sharpe_uses_full_frames_only(spark):
    rets = [0.01, 0.02, -0.01, 0.03, 0.0]
    frame = spark.createDataFrame([("r", k, v) for k, v in enumerate(rets)], "run string, k int, ret double")
    out = {r["k"]: r["rolling_sharpe"] for r in metrics.rolling_sharpe(frame, ["run"], 3, 12).collect()}
    assert sorted(out) == [2, 3, 4]
    chunk = pd.Series(rets[0:3])
    assert out[2] == pytest.approx(chunk.mean() / chunk.std(ddof=0) * 12 ** 0.5)
    short = metrics.rolling_sharpe(frame, ["run"], 99, 12).collect()
    assert [r["k"] for r in short] == [4]


def test_static_weights_clip_and_normalise(spark):
    days = Calendar.between("2020-01-01", "2020-01-31")
    rows = spark.createDataFrame([("A", 3.0), ("B", -1.0), ("C", 1.0)], "symbol string, weight double")
    assert {r["symbol"]: r["weight"] for r in w.static_weights(rows, days).collect()} == {"A": 0.75, "B": 0.0, "C": 0.25}
    nothing = spark.createDataFrame([("A", -1.0)], "symbol string, weight double")
    assert [r["weight"] for r in w.static_weights(nothing, days).collect()] == [0.0]
    assert [r["weight"] for r in w.normalise(nothing.withColumn("k", w.F.lit(0)), ["k"]).collect()] == [1.0]


def test_random_weights_are_reproducible_and_sum_to_one(spark):
    days = Calendar.between("2020-01-01", "2020-06-30")
    names = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    a, b = (sorted(map(tuple, w.random_weights(names, days, 3).collect())) for _ in range(2))
    assert a == b
    assert a != sorted(map(tuple, w.random_weights(names, days, 4).collect()))
    sums = pd.DataFrame(a, columns=["run", "k", "symbol", "weight"]).groupby("k")["weight"].sum()
    assert sums.to_list() == pytest.approx([1.0] * 6)


def test_hedge_weights(spark):
    days = Calendar.between("2020-01-01", "2020-02-29")
    chosen = spark.createDataFrame([(1, "P"), (1, "Q")], "k int, symbol string")
    rows = {(r["k"], r["symbol"]): r["weight"] for r in w.hedge_weights(chosen, days, "T", 0.3).collect()}
    assert rows == {(0, "T"): 1.0, (1, "T"): pytest.approx(0.7), (1, "P"): pytest.approx(0.15), (1, "Q"): pytest.approx(0.15)}


def test_regime_rules(spark):
    rows = spark.createDataFrame([(None, None), (0.1, -0.5), (-0.1, 0.5), (0.1, 0.5), (None, 0.2), (-0.2, None)], "trend double, curve double")
    from pitspark.functions.columns import regime
    got = [(r["s"]["label"], r["s"]["confidence"]) for r in rows.select(regime(w.F.col("trend"), w.F.col("curve")).alias("s")).collect()]
    assert got == [("unknown", 0.0), ("defensive", 0.75), ("defensive", 0.65), ("risk_on", 0.60), ("risk_on", 0.60), ("defensive", 0.65)]
