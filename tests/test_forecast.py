import random
from datetime import datetime

import numpy as np
import pytest

from pitspark.operators import forecast as f
from pitspark.operators.asof import history_asof
from pitspark.operators.calendars import Calendar
from pitspark.schemas import PRICES
from pitspark.session import materialise


def test_gradient_agrees_with_finite_differences():
    net = f.Network(lookback=3, hidden=2)
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(9, 3)), rng.normal(size=9), net.start() + rng.normal(0, 0.3, net.size)
    slope = net.gradient(w, x, y)[:-1]
    for i in range(net.size):
        step = np.zeros(net.size)
        step[i] = 1e-6
        numeric = (net.gradient(w + step, x, y)[-1] - net.gradient(w - step, x, y)[-1]) / 2e-6
        assert slope[i] == pytest.approx(numeric, rel=1e-5, abs=1e-7)


def panel(n=60, later=0.0):
    draw = random.Random(2)
    rows = []
    for symbol in ("A", "B"):
        price = 100.0
        for i in range(n):
            day = datetime(2015 + i // 12, i % 12 + 1, 1)
            price *= 1 + draw.uniform(-0.05, 0.06)
            rows.append((symbol, day, day, price + (later if i >= 48 else 0.0), False))
    return rows


def plain_fit(net, x, y):
    """The same descent in one place."""
    mean, std = x.mean(0), x.std(0)
    xs, ys = (x - mean) / std, (y - y.mean()) / y.std()
    w, trace = net.start(), []
    for _ in range(net.epochs):
        g = net.gradient(w, xs, ys) / len(ys)
        trace.append(g[-1])
        w = w - net.rate * g[:-1]
    return w, trace


@pytest.mark.parametrize("together", [f.TOGETHER, 10])
def test_distributed_training_equals_training_in_one_place(spark, together, monkeypatch):
    """Whole dates and, where they are too large, blocks of about seven windows."""
    monkeypatch.setattr(f, "BLOCK", 7)
    days = Calendar.of([datetime(2018, 1, 31), datetime(2019, 12, 31)])
    history = history_asof(spark.createDataFrame(panel(), PRICES), days)
    nets = [f.Network(lookback=3, hidden=2, epochs=5), f.Network(lookback=3, hidden=3, epochs=3, seed=4, rate=0.2), f.Network(lookback=3, min_obs=500)]
    rows = materialise(f.windows(history, 3), "windows")
    got = {(r["net"], r["k"]): r for r in f.train(rows, nets, together).collect()}
    assert set(got) == {(i, k) for i in (0, 1) for k in (0, 1)}
    for k in (0, 1):
        frame = rows.filter(f"k = {k}").toPandas()
        x, y = np.stack(frame["x"]), frame["y"].to_numpy()
        for i, net in enumerate(nets[:2]):
            want, trace = plain_fit(net, x, y)
            assert np.allclose(got[i, k]["weights"], want, atol=1e-10) and np.allclose(got[i, k]["losses"], trace, atol=1e-10)
            assert got[i, k]["n"] == len(y) and np.allclose(got[i, k]["mean"][:-1], x.mean(0)) and len(got[i, k]["losses"]) == net.epochs
    assert got[0, 1]["losses"][-1] < got[0, 1]["losses"][0]


def test_answers_are_the_networks(spark):
    days = Calendar.of([datetime(2019, 12, 31)])
    history = history_asof(spark.createDataFrame(panel(), PRICES), days)
    nets = [f.Network(lookback=3, hidden=2, epochs=5), f.Network(lookback=5, hidden=3, epochs=2, seed=1)]
    rows, trace = f.forecast(history, ["A", "B"], days, nets)
    got = {(r["net"], r["symbol"]): r["expected_return"] for r in rows.collect()}
    for i, net in enumerate(nets):
        frame = f.windows(history, net.lookback).toPandas()
        x, y = np.stack(frame["x"]), frame["y"].to_numpy()
        weights, losses = plain_fit(net, x, y)
        newest = {r["symbol"]: np.array(r["x"]) for r in f.newest_windows(f.windows(history, net.lookback)).collect()}
        for symbol in "AB":
            want = net.predict(weights, (newest[symbol] - x.mean(0)) / x.std(0))[0] * y.std() + y.mean()
            assert got[i, symbol] == pytest.approx(want, abs=1e-12)
        assert [r["loss"] for r in trace.filter(f"net = {i}").orderBy("epoch").collect()] == pytest.approx(losses)


def test_forecasts_do_not_see_the_future_and_thin_dates_degrade(spark):
    days = Calendar.of([datetime(2015, 6, 30), datetime(2018, 12, 31)])
    net = f.Network(lookback=3, hidden=2, epochs=3)

    def run(rows):
        out, _ = f.forecast(history_asof(spark.createDataFrame(rows, PRICES), days), ["A", "B"], days, [net])
        return {(r["k"], r["symbol"]): (round(r["expected_return"], 12), r["status"]) for r in out.collect()}

    now, other = run(panel()), run(panel(later=55.0))
    assert now == other
    assert now[(0, "A")] == (0.0, "degraded") and now[(1, "A")][1] == "ok"
