"""Optimal weights: every support tried out, optimality conditions, and closed forms against the critical line."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.operators import allocation


def _by_supports(mu, cov, cap):
    """Best return under the cap over all sets of held symbols, else the least variance; None where none fits."""
    n, best, calm = len(mu), None, None
    for size in range(1, n + 1):
        for held in combinations(range(n), size):
            held = list(held)
            system = np.block([[cov[np.ix_(held, held)], -np.ones((size, 1))], [np.ones((1, size)), np.zeros((1, 1))]])
            try:
                a, b = np.linalg.solve(system, np.column_stack([[0.0] * size + [1.0], [*mu[held], 0.0]])).T[:, :size]
            except np.linalg.LinAlgError:
                continue
            c = cov[np.ix_(held, held)]
            if a.min() >= -1e-12 and (calm is None or a @ c @ a < calm):
                calm = a @ c @ a
            roots = [0.0] if a @ c @ a <= cap ** 2 and size == 1 else []
            if b @ c @ b > 1e-14:
                bend, cross, flat = b @ c @ b, a @ c @ b, a @ c @ a - cap ** 2
                if cross * cross >= bend * flat:
                    roots.append((-cross + np.sqrt(cross * cross - bend * flat)) / bend)
            for t in roots:
                w = a + t * b
                if t >= 0 and w.min() >= -1e-9 and w @ c @ w <= cap ** 2 * (1 + 1e-9):
                    best = max(best, w @ mu[held]) if best is not None else w @ mu[held]
    return best, calm


def _case(seed, n, kind):
    draw = np.random.default_rng(seed)
    a = draw.normal(0, 0.3, (n, n + 3 if kind != "singular" else max(1, n - 2)))
    mu = draw.normal(0.05, 0.1, n)
    if kind == "ties":
        mu = np.round(mu, 1)
    return mu, a @ a.T / 4


@pytest.mark.parametrize("kind", ["plain", "ties", "singular"])
@pytest.mark.parametrize("seed", range(12))
def test_every_support(kind, seed):
    n = 2 + seed % 5
    mu, cov = _case(seed, n, kind)
    calmest = allocation.critical_line(mu, cov, 0.0).weights
    low = np.sqrt(max(calmest @ cov @ calmest, 0.0))
    for cap in (*([low * 0.5] if kind != "singular" else []), low * 1.05 + 1e-4, low * 1.3 + 1e-3, 0.3, 9.0):
        found = allocation.critical_line(mu, cov, cap)
        w = found.weights
        best, calm = _by_supports(mu, cov, cap)
        assert found.residual < 1e-7 and w.sum() == pytest.approx(1.0, abs=1e-9)
        if found.regime == "least_variance":
            assert w @ cov @ w == pytest.approx(calm, abs=1e-9)
        else:
            assert w @ cov @ w <= cap ** 2 * (1 + 1e-7)
            assert w @ mu >= (best if best is not None else -np.inf) - 1e-7


@pytest.mark.parametrize("top", [0.2, 0.34, 0.5])
def test_limits_and_many_symbols(top):
    for n in (6, 40):
        mu, cov = _case(n, n, "plain")
        for cap in (0.01, 0.1, 0.15, 5.0):
            found = allocation.critical_line(mu, cov, cap, top)
            assert found.residual < 1e-7 and found.weights.max() <= top + 1e-9


def test_all_alike_and_no_risk():
    for mu, cov in ((np.full(4, 0.1), np.eye(4) * 0.04), (np.array([0.2, 0.1]), np.zeros((2, 2))), (np.zeros(3), np.ones((3, 3))), (np.array([0.1]), np.array([[0.09]]))):
        for cap in (0.05, 0.1, 0.2, 0.5):
            found = allocation.critical_line(mu, cov, cap)
            assert found.residual < 1e-6 and found.weights.sum() == pytest.approx(1.0)


@pytest.mark.parametrize("cap", [0.05, 0.12, 0.2, 0.6])
def test_closed_form_for_independent_risks(spark, cap):
    draw, rows, want = np.random.default_rng(1), [], {}
    for k in range(30):
        n = 1 + k % 7
        mu, sigma = draw.normal(0.05, 0.1, n), draw.uniform(0.05, 0.5, n)
        if k % 5 == 0:
            mu = np.round(mu, 1)
        found = allocation.critical_line(mu, np.diag(sigma ** 2), cap)
        want[k] = (found.weights @ mu, found.weights @ (sigma ** 2 * found.weights), found.regime)
        rows += [(k, f"S{i}", float(m), float(s)) for i, (m, s) in enumerate(zip(mu, sigma))]
    got = allocation.water_levels(spark.createDataFrame(rows, "k int, symbol string, mu double, sigma double"), cap)
    sums = got.groupBy("k").agg(F.sum("weight").alias("all"), F.min("weight").alias("least"), F.sum(F.col("weight") * F.col("mu")).alias("gain"),
                                F.sum(F.col("weight") ** 2 * F.col("sigma") ** 2).alias("variance"), F.first("regime").alias("regime")).collect()
    assert len(sums) == 30
    for r in sums:
        gain, variance, regime = want[r["k"]]
        assert r["all"] == pytest.approx(1.0, abs=1e-9) and r["least"] >= 0
        if regime == "least_variance":
            assert r["regime"] == regime and r["variance"] == pytest.approx(variance, abs=1e-10)
        else:
            assert r["gain"] == pytest.approx(gain, abs=1e-8) and r["variance"] <= cap ** 2 * (1 + 1e-8)


def test_degraded_dates_are_equal_weight_and_a_limit_is_kept(spark):
    rows = [(0, "A", 0.2, 0.3, "ok"), (0, "B", 0.1, 0.2, "ok"), (1, "A", 0.2, 0.3, "ok"), (1, "B", 0.0, 0.0, "degraded"), (2, "A", 0.2, 0.3, "ok"), (0, "Z", 0.9, 0.1, "ok")]
    frame = spark.createDataFrame(rows, "k int, symbol string, expected_return double, volatility double, status string")
    got = {(r["k"], r["symbol"]): r["weight"] for r in allocation.diagonal_allocation(frame, ["A", "B"], 0.25).collect()}
    assert set(got) == {(k, s) for k in range(3) for s in "AB"} and {got[k, s] for k in (1, 2) for s in "AB"} == {0.5}
    assert got[0, "A"] > got[0, "B"] > 0
    limited = {(r["k"], r["symbol"]): r["weight"] for r in allocation.diagonal_allocation(frame, ["A", "B"], 0.25, w_max=0.6).collect()}
    assert max(limited.values()) <= 0.6 + 1e-9 and {limited[k, s] for k in (1, 2) for s in "AB"} == {0.5}
