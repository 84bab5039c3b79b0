import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.operators import allocation, screen, universe
from pitspark.operators.asof import history_asof
from pitspark.operators.calendars import Calendar
from pitspark.schemas import PRICES


def ts(text):
    return datetime.fromisoformat(text)


def best_set(spans, need, least):
    """Every subset, largest first; ties by window, then by the last sorted tuple."""
    for size in range(len(spans), least - 1, -1):
        found = []
        for names in itertools.combinations(sorted(spans), size):
            start, end = max(spans[n][0] for n in names), min(spans[n][1] for n in names)
            months = (end - start).days / 30.4375 if end >= start else -1.0
            if months >= need:
                found.append((months, names))
        if found:
            return set(max(found)[1])
    return set()


@pytest.mark.parametrize("seed", range(10))
def test_universe_equals_enumeration(spark, seed):
    draw = random.Random(seed)
    spans = {}
    for i in range(draw.randint(1, 8)):
        start = ts("2010-01-01") + timedelta(days=draw.randrange(0, 900, draw.choice([1, 90])))
        spans[f"s{i}"] = (start, start + timedelta(days=draw.randrange(0, 1200, draw.choice([1, 60]))))
    rows = spark.createDataFrame([(n, a, b) for n, (a, b) in spans.items()], "symbol string, start timestamp_ntz, end timestamp_ntz")
    need, least = draw.choice([3.0, 12.0, 18.0]), draw.choice([2, 3])
    got = {r["symbol"] for r in universe.cotemporal_universe(rows, need, least).collect()}
    assert got == best_set(spans, need, least)


def monthly(symbol, start, months, price=10.0):
    out, day = [], ts(start)
    for i in range(months):
        out.append((symbol, day, day, price + i % 5, False))
        day = datetime(day.year + day.month // 12, day.month % 12 + 1, 1)
    return out


def test_sufficiency_reasons(spark):
    def verdict(rows, **kw):
        return universe.sufficiency(spark.createDataFrame(rows, PRICES), **kw).head()

    good = verdict(monthly("LONGA", "2010-01-01", 180) + monthly("LONGB", "2011-01-01", 168) + monthly("SHORT", "2026-01-01", 4))
    assert (good["reason"], good["universe_size"], good["asset_count"]) == ("ok", 2, 3)
    assert good["homogeneous"] and 28 <= good["coarsest_days"] <= 31
    assert verdict(monthly("A", "2018-01-01", 12) + monthly("B", "2023-01-01", 12))["reason"] == "no_cotemporal_overlap"
    assert verdict(monthly("A", "2018-01-01", 12) + monthly("B", "2018-01-01", 12))["reason"] == "history_below_min_window"
    assert verdict(monthly("A", "2018-01-01", 40))["reason"] == "fewer_than_min_assets"
    poisoned = [(s, e, a, float("nan"), f) for s, e, a, _, f in monthly("B", "2018-01-01", 40)]
    assert verdict(monthly("A", "2018-01-01", 40) + poisoned)["reason"] == "fewer_than_min_assets"


def test_cadence_of_intraday_events_matches_the_plain_median(spark):
    draw = random.Random(3)
    rows = [("A", ts("2024-01-01") + timedelta(minutes=draw.randrange(0, 60 * 24 * 20)), None, 1.0, False) for _ in range(60)]
    rows += [("B", ts("2024-01-01") + timedelta(days=7 * i), None, 1.0, False) for i in range(5)] + [("C", ts("2024-01-01"), None, 1.0, False)]
    got = {r["symbol"]: (r["median_days"], r["cadence"]) for r in universe.sampling(spark.createDataFrame(rows, PRICES)).collect()}
    times = sorted({e for s, e, *_ in rows if s == "A"})
    assert got["A"][0] == float(np.median([(b - a).days for a, b in zip(times, times[1:])]))
    assert got["B"] == (7.0, "weekly") and got["C"] == (0.0, "irregular")


def test_planted_cointegration_is_found_and_a_random_walk_is_not(spark):
    rng = np.random.default_rng(7)
    target = 100 + np.cumsum(rng.normal(0, 1, 120))
    series = {"TSMC": target, "PLANT": 150 - 0.5 * target + rng.normal(0, 0.5, 120), "RAND": 100 + np.cumsum(rng.normal(0, 1, 120))}
    days = Calendar.between("2010-01-01", "2019-12-31").dates
    rows = [(s, d, d, float(v), False) for s, values in series.items() for d, v in zip(days, values)]
    at = Calendar.of([days[20], days[-1]])
    tested = {(r["k"], r["symbol"]): r for r in screen.cointegration(history_asof(spark.createDataFrame(rows, PRICES), at), "TSMC").collect()}
    assert tested[(1, "PLANT")]["selected"] and tested[(1, "PLANT")]["hedge_ratio"] < 0 and tested[(1, "PLANT")]["p_value"] < 0.01
    assert not tested[(1, "RAND")]["selected"]
    assert not tested[(0, "PLANT")]["selected"] and tested[(0, "PLANT")]["t_stat"] is None
    assert [r["symbol"] for r in screen.ranking(screen.cointegration(history_asof(spark.createDataFrame(rows, PRICES), at), "TSMC")).collect()] == ["PLANT"]


def test_unit_root_quantiles_meet_the_published_critical_values(spark):
    rows = spark.createDataFrame([(-3.43,), (-2.86,), (-2.57,)], "t double")
    from pitspark.functions.columns import normal_cdf
    got = [r["p"] for r in rows.select(normal_cdf(screen.unit_root_z(F.col("t"))).alias("p")).collect()]
    assert got == pytest.approx([0.01, 0.05, 0.10], abs=0.002)


# -- allocation ---------------------------------------------------------------


def simplex_grid(n, ticks):
    for cut in itertools.combinations(range(ticks + n - 1), n - 1):
        edges = (-1, *cut, ticks + n - 1)
        yield np.array([b - a - 1 for a, b in zip(edges, edges[1:])]) / ticks


@pytest.mark.parametrize("seed", range(6))
def test_solver_beats_a_fine_grid(seed):
    rng = np.random.default_rng(seed)
    n = 3
    a = rng.normal(0, 0.3, (n, n + 2))
    cov, mu = a @ a.T / 4, rng.normal(0.05, 0.1, n)
    grid = np.array(list(simplex_grid(n, 60)))
    variances = np.einsum("bi,ij,bj->b", grid, cov, grid)
    for cap in (np.sqrt(variances.min()) * 0.5, np.sqrt(np.quantile(variances, 0.3)), 9.0):
        w = allocation.solve(mu[None], cov[None], np.array([cap]))[0]
        assert w.sum() == pytest.approx(1.0) and w.min() >= -1e-12
        fits = variances <= cap ** 2
        if fits.any():
            assert w @ cov @ w <= cap ** 2 * (1 + 1e-6)
            assert w @ mu >= (grid[fits] @ mu).max() - 1e-6
        else:
            assert w @ cov @ w <= variances.min() + 1e-9


def test_solver_respects_the_weight_limit_and_gains_from_a_looser_cap():
    mu, cov = np.array([[0.2, 0.1, 0.05, 0.01]]), np.diag([0.09, 0.04, 0.02, 0.01])[None]
    gains = []
    for cap in (0.05, 0.1, 0.15, 0.2, 0.3):
        w = allocation.solve(mu, cov, np.array([cap]), 0.4)[0]
        assert w.max() <= 0.4 + 1e-9
        gains.append(float(w @ mu[0]))
    assert gains == sorted(gains)


def test_thin_history_is_equal_weight(spark):
    rows = monthly("A", "2019-01-01", 10) + monthly("B", "2019-01-01", 10, 20.0)
    days = Calendar.between("2019-06-01", "2019-10-31")
    history = history_asof(spark.createDataFrame(rows, PRICES), days)
    got = allocation.mean_variance(history, ["A", "B"], days, 0.3).collect()
    assert len(got) == 10 and {r["weight"] for r in got} == {0.5}
    mixed = allocation.multi_horizon(history, ["A", "B"], days).collect()
    assert len(mixed) == 10 and {r["weight"] for r in mixed} == {0.5}
