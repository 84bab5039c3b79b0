"""Means and covariances of any number of symbols against numpy."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.operators import moments
from pitspark.operators.calendars import Calendar

SCHEMA = "k int, symbol string, event_date timestamp_ntz, close double"
DAYS = Calendar.of([datetime(2020, 1, 31), datetime(2020, 2, 29), datetime(2020, 3, 31)])


def _history(symbols, periods, seed=0):
    """Dates 0 and 1 hold different lengths, date 2 nothing; some closes are missing or not a number."""
    draw, rows = np.random.default_rng(seed), []
    for k, n in ((0, periods), (1, periods // 2)):
        levels = 50 + np.cumsum(draw.normal(0, 1, (n, len(symbols))), 0)
        levels[3, 0], levels[5, 1] = np.nan, np.nan
        for i in range(n):
            rows += [(k, s, datetime(2010, 1, 1) + timedelta(days=30 * i), float(levels[i, j])) for j, s in enumerate(symbols) if not (i == 7 and j == 2)]
    return rows


def _plain(rows, symbols, k, lookback):
    table = {}
    for kk, s, date, close in rows:
        if kk == k and not np.isnan(close) and s in symbols:
            table.setdefault(date, {})[s] = close
    levels = np.array([[table[d][s] for s in symbols] for d in sorted(table) if len(table[d]) == len(symbols)])
    rets = (levels[1:] / levels[:-1] - 1)[-lookback:]
    return len(rets), rets.mean(0) * 12, np.cov(rets.T) * 12


@pytest.mark.parametrize("size, block", [(5, 2), (70, 16), (9, 64)])
def test_blocks_give_every_pair_once(spark, size, block):
    symbols = [f"S{i}" for i in range(size)]
    rows = _history(symbols, 60) + [(0, "OTHER", datetime(2010, 1, 1), 1.0)]
    names = spark.createDataFrame([(s,) for s in symbols] + [(None,), ("S0",)], "symbol string")
    means, covariances = moments.block_moments(spark.createDataFrame(rows, SCHEMA), names, [12, 40], min_obs=11, block=block)
    mu = {(r["k"], r["horizon"], r["symbol"]): (r["n"], r["mu"]) for r in means.collect()}
    got = [(r["k"], r["horizon"], r["s1"], r["s2"], r["covariance"]) for r in covariances.collect()]
    cov = {g[:4]: g[4] for g in got}
    assert len(got) == len(cov) == 4 * size * size and len(mu) == 4 * size
    for k in (0, 1):
        for h, lookback in enumerate((12, 40)):
            n, want_mu, want_cov = _plain(rows, symbols, k, lookback)
            assert [mu[k, h, s] for s in symbols] == [(n, pytest.approx(m, abs=1e-12)) for m in want_mu]
            assert np.allclose([[cov[k, h, a, b] for b in symbols] for a in symbols], want_cov, atol=1e-12)


def test_more_symbols_than_columns(spark):
    symbols = [f"S{i}" for i in range(moments.WIDE + 6)]
    rows = _history(symbols, 50, seed=2)
    got = {(r["k"], r["horizon"]): r for r in moments.horizon_moments(spark.createDataFrame(rows, SCHEMA), symbols, DAYS, [12, 40], min_obs=22).collect()}
    n, mu, cov = _plain(rows, symbols, 0, 40)
    assert got[0, 1]["n"] == n and np.allclose(got[0, 1]["mu"], mu, atol=1e-12) and np.allclose(np.reshape(got[0, 1]["cov"], cov.shape), cov, atol=1e-12)
    assert {x: (r["n"], r["mu"], r["cov"]) for x, r in got.items() if x != (0, 1)} == {(k, h): (0, None, None) for k in range(3) for h in range(2) if (k, h) != (0, 1)}


def test_both_forms_agree(spark, monkeypatch):
    symbols = [f"S{i}" for i in range(6)]
    frame = spark.createDataFrame(_history(symbols, 40, seed=1), SCHEMA)
    wide = moments.moments(frame, symbols, DAYS, 36, 15).collect()
    monkeypatch.setattr(moments, "WIDE", 0)
    long = moments.moments(frame, symbols, DAYS, 36, 15).collect()
    for a, b in zip(sorted(wide, key=lambda r: r["k"]), sorted(long, key=lambda r: r["k"])):
        assert (a["k"], a["n"]) == (b["k"], b["n"])
        assert (a["mu"] is None) == (b["mu"] is None)
        if a["mu"]:
            assert np.allclose(a["mu"], b["mu"]) and np.allclose(a["cov"], b["cov"])


def test_nothing_known(spark):
    frame = spark.createDataFrame([], SCHEMA)
    means, covariances = moments.block_moments(frame, spark.createDataFrame([("A",)], "symbol string"), [12])
    assert means.collect() == [] and covariances.collect() == []
    assert moments.block_moments(frame, frame.select("symbol"), [12])[1].filter(F.lit(True)).collect() == []
