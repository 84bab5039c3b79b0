"""Lag choice and unit-root statistics against ordinary least squares, lag by lag."""

import numpy as np
import pytest
from pitspark.operators import screen, unitroot
from pitspark.operators.asof import history_asof
from pitspark.operators.calendars import Calendar
from pitspark.schemas import PRICES


def _ols(e, lags, first):
    """Residual sum of squares, t statistic of the level and number of rows, from row ``first`` on."""
    d, rows = np.diff(e), range(first, len(e) - 1)
    x = np.array([[1.0, e[t], *(d[t - j] for j in range(1, lags + 1))] for t in rows])
    y = d[list(rows)]
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    ssr = float(((y - x @ beta) ** 2).sum())
    error = np.sqrt(ssr / (len(y) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    return ssr, beta[1] / error, len(y)


def _plain(e):
    most = unitroot.most_lags(len(e))
    fits = []
    for lags in range(most + 1):
        ssr, _, m = _ols(e, lags, most)
        fits.append((m * np.log(ssr / m) + 2 * (lags + 2), lags))
    lag = min(fits)[1]
    return lag, _ols(e, lag, lag)[1]


def _series(seed, n, phi):
    draw, e = np.random.default_rng(seed), [0.0] * 3
    for _ in range(n - 3):
        e.append(sum(p * x for p, x in zip(phi, reversed(e))) + draw.normal())
    return np.array(e)


@pytest.mark.parametrize("phi", [(0.5,), (1.0,), (0.4, 0.0, 0.5), (1.3, -0.4), (0.2, -0.6)])
def test_lag_and_statistic(phi):
    series = [_series(i, n, phi) for i, n in enumerate((30, 31, 84, 84, 120, 400))]
    lags, ts = unitroot.test_series(series)
    want = [_plain(e) for e in series]
    assert lags.tolist() == [w[0] for w in want]
    assert ts == pytest.approx([w[1] for w in want], rel=1e-8)


def test_orders_differ_between_series():
    found = {unitroot.test_series([_series(s, 300, phi)])[0][0] for s, phi in enumerate([(0.5,), (0.4, 0.0, 0.5), (1.3, -0.4)])}
    assert len(found) > 1 and max(found) >= 2


def test_short_constant_and_broken_series():
    lags, ts = unitroot.test_series([np.array([]), np.array([1.0, 2.0, 4.0]), np.ones(50), np.array([1.0] * 40 + [np.nan]), _series(1, 60, (0.5,))])
    assert lags[:4].tolist() == [-1] * 4 and np.isnan(ts[:4]).all() and np.isfinite(ts[4])


def test_limit_of_lags():
    series = [_series(4, 200, (0.4, 0.0, 0.5))]
    assert unitroot.test_series(series, 0)[0][0] == 0
    assert unitroot.test_series(series, 0)[1] == pytest.approx([_ols(series[0], 0, 0)[1]])


def test_schwert_rule():
    assert [unitroot.most_lags(n) for n in (3, 4, 30, 84, 100, 1000)] == [-1, 0, 9, 12, 12, 22]


def test_screen_reports_the_lag_of_each_candidate(spark):
    draw = np.random.default_rng(3)
    target = 100 + np.cumsum(draw.normal(0, 1, 120))
    slow = _series(8, 120, (0.4, 0.0, 0.5))
    series = {"T": target, "SLOW": 150 - 0.5 * target + slow, "FLAT": np.full(120, 7.0), "SHORT": target[:20]}
    days = Calendar.between("2010-01-01", "2019-12-31").dates
    rows = [(s, d, d, float(v), False) for s, values in series.items() for d, v in zip(days, values)]
    prices = spark.createDataFrame(rows, PRICES)
    got = {r["symbol"]: r for r in screen.cointegration(history_asof(prices, Calendar.of([days[-1]])), "T").collect()}
    slope, intercept = np.polyfit(target, series["SLOW"], 1)
    lag, t = _plain(series["SLOW"] - slope * target - intercept)
    assert got["SLOW"]["lag"] == lag and got["SLOW"]["t_stat"] == pytest.approx(t, rel=1e-6) and got["SLOW"]["reverse"]
    assert got["SHORT"]["n"] == 20 and got["SHORT"]["lag"] is None and got["SHORT"]["p_value"] is None and not got["SHORT"]["selected"]
    assert not got["FLAT"]["selected"]
