"""Long-only allocation: highest return under a volatility cap.

The universe of one allocation is configuration (a handful of symbols), the
number of allocations is not: dates, horizons and parameter sets are rows. Each
row carries its means and covariance as arrays and is solved on its own along its critical
line in a Pandas UDF, so rows spread over the cluster in any way Spark likes and none waits
for another. Where risks are independent the weights have a closed form over ordered means,
in column expressions.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .calendars import Calendar
from .moments import horizon_moments, moments
from .weights import COLUMNS

# workers get the solver with the task, so they need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: relative size of what separates equal means and keeps a singular covariance solvable
NUDGE = 1e-12
NUDGED_MOST = 1e-6
#: violation of the optimality conditions that rounding may leave
EXACT = 1e-8


@dataclass(frozen=True)
class Solution:
    """Weights and the multipliers that show them to be optimal.

    ``regime`` is ``corner`` (the cap does not bind), ``cap`` (it does) or ``least_variance``
    (it cannot be met). With ``tilt`` t and ``level`` g the weights solve
    min w'Cw/2 - t * mu'w: C w - t * mu - g is zero where a weight lies between its bounds,
    not negative at zero and not positive at the limit. ``residual`` is the largest violation
    of this, of the bounds, of the sum and of the cap, each relative to its scale.
    """

    weights: np.ndarray
    regime: str
    tilt: float | None
    level: float | None
    residual: float


def _checked(w: np.ndarray, mu: np.ndarray, cov: np.ndarray, cap: float, top: float, regime: str, tilt: float | None, level: float | None) -> Solution:
    curve = np.zeros(len(mu)) if tilt is None else cov @ w
    slope = curve - (1.0 if tilt is None else tilt) * mu - level
    returns = max(np.abs(mu).max(), np.sqrt(np.trace(cov) / len(mu)), 1e-300)  # returns are measured against risk where they are nil
    scale = max(np.abs(cov).max() if tilt is not None else 0.0, (1.0 if tilt is None else tilt) * returns)
    edge = 1e-9
    off = np.where(w <= edge, np.maximum(-slope, 0.0), np.where(w >= top - edge, np.maximum(slope, 0.0), np.abs(slope))) / scale
    over = 0.0 if regime == "least_variance" else max(w @ cov @ w - cap * cap, 0.0) / max(cap * cap, edge * np.abs(cov).max(), 1e-300)
    return Solution(w, regime, tilt, level, float(max(off.max(), abs(w.sum() - 1.0), -w.min(), w.max() - top, over, 0.0)))


def critical_line(mu: np.ndarray, cov: np.ndarray, cap: float, top: float = 1.0) -> Solution:
    """max mu'w with w'Cw <= cap^2, sum one and 0 <= w <= top; the least-variance weights where none qualify.

    Starts at the richest corner and follows the efficient frontier down. Between two turning
    points the weights are linear in the tilt, so each is met exactly; a turning point moves one
    weight to or from a bound. It ends where the variance meets the cap or the tilt is zero.
    A set of bounds that came before, or conditions that do not hold at the end, mean a tie or a
    singular covariance; then means and variances are nudged apart, ever further.
    """
    n = len(mu)
    top = max(top, 1.0 / n)
    ridge = max(np.trace(cov) / n, 1e-12)
    mean_size = max(np.abs(mu).max(), np.sqrt(ridge))
    order = np.argsort(-mu, kind="stable")
    corner = np.zeros(n)
    corner[order] = np.clip(1.0 - np.arange(n) * top, 0.0, top)
    last = order[np.flatnonzero(corner[order] > 0)[-1]]
    if corner @ cov @ corner <= cap * cap:
        return _checked(corner, mu, cov, cap, top, "corner", None, -mu[last])
    nudge = 0.0
    while True:
        rich = mu.copy()
        rich[order] -= nudge * mean_size * np.arange(n)
        found = _follow(rich, cov + nudge * ridge * np.eye(n), cov, cap, top, corner, last)
        if found is not None:
            w, regime, tilt, level = found
            solution = _checked(np.clip(w, 0.0, top), mu, cov, cap, top, regime, tilt, level)
            if solution.residual < EXACT or nudge > NUDGED_MOST:
                return solution
        nudge = max(NUDGE, 8.0 * nudge)


def _follow(mu, solid, cov, cap, top, corner, last):
    n = len(mu)
    side = np.where(corner > 0, 1, -1)  # at the limit, at zero, or free
    side[last] = 0
    tilt, seen = np.inf, set()
    while True:
        if side.tobytes() in seen:
            return None
        seen.add(side.tobytes())
        free, fixed = np.flatnonzero(side == 0), np.flatnonzero(side > 0)
        m = len(free)
        system = np.zeros((m + 1, m + 1))
        system[:m, :m], system[:m, m], system[m, :m] = solid[np.ix_(free, free)], -1.0, 1.0
        right = np.zeros((m + 1, 2))
        right[:m, 0], right[m, 0], right[:m, 1] = -solid[np.ix_(free, fixed)].sum(1) * top, 1.0 - top * len(fixed), mu[free]
        try:
            solved = np.linalg.solve(system, right)
        except np.linalg.LinAlgError:
            return None
        if not np.isfinite(solved).all():
            return None
        a, b = np.zeros(n), np.zeros(n)
        a[fixed] = top
        a[free], b[free] = solved[:m, 0], solved[:m, 1]
        p, q = solid @ a - solved[m, 0], solid @ b - mu - solved[m, 1]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            turn = np.where(side == 0, np.where(b > 0, -a / b, np.where(b < 0, (top - a) / b, -np.inf)),
                            np.where((side < 0) & (q > 0) | (side > 0) & (q < 0), -p / q, -np.inf))
        turn = np.where(np.isfinite(turn), np.minimum(turn, tilt), -np.inf)
        i = int(turn.argmax())
        stop = max(turn[i], 0.0)
        flat, cross, bend = a @ cov @ a, a @ cov @ b, b @ cov @ b
        if flat + 2.0 * stop * cross + stop * stop * bend <= cap * cap:
            at = stop
            if bend > 0:
                at = (-cross + np.sqrt(max(cross * cross - bend * (flat - cap * cap), 0.0))) / bend
                at = min(max(at, stop), tilt)
            return a + at * b, "cap", at, solved[m, 0] + at * solved[m, 1]
        if stop == 0.0:
            return a, "least_variance", 0.0, solved[m, 0]
        side[i] = 0 if side[i] else (-1 if b[i] > 0 else 1)
        tilt = stop


def solve(mu: np.ndarray, cov: np.ndarray, cap: np.ndarray, top: float = 1.0) -> np.ndarray:
    """Weights per row."""
    return np.stack([critical_line(m, c, float(x), top).weights for m, c, x in zip(mu, cov, cap)])


SOLUTION = "struct<w:array<double>,regime:string,tilt:double,level:double,residual:double>"


def _solve_rows(mu: pd.Series, cov: pd.Series, cap: pd.Series, top: pd.Series) -> pd.DataFrame:
    rows = []
    for m, c, x, t in zip(mu, cov, cap, top):
        if m is None:
            rows.append((None,) * 5)
            continue
        m = np.asarray(m, float)
        found = critical_line(m, np.asarray(c, float).reshape(len(m), len(m)), float(x), float(t))
        rows.append((found.weights.tolist(), found.regime, found.tilt, found.level, found.residual))
    return pd.DataFrame(rows, columns=["w", "regime", "tilt", "level", "residual"]).astype({c: "Float64" for c in ("tilt", "level", "residual")})


def optimum(mu: Column, cov: Column, vol_cap: Column, w_max: Column) -> Column:
    """struct(w, regime, tilt, level, residual): weights with the multipliers that prove them; null where the mean is."""
    return pandas_udf(_solve_rows, SOLUTION)(mu, cov, vol_cap, w_max)


def best_weights(mu: Column, cov: Column, vol_cap: Column, w_max: Column) -> Column:
    return optimum(mu, cov, vol_cap, w_max)["w"]


def _spread(rows: DataFrame, symbols: list[str], run: str) -> DataFrame:
    """(k, w array or null) to weight rows; null is equal weight."""
    equal = F.array(*[F.lit(1.0 / len(symbols)) for _ in symbols])
    names = F.array(*[F.lit(s) for s in symbols])
    pairs = F.explode(F.arrays_zip(names.alias("symbol"), F.coalesce("w", equal).alias("weight")))
    return rows.select("k", pairs.alias("p")).select(F.lit(run).alias("run"), "k", "p.symbol", "p.weight").select(*COLUMNS)


def mean_variance(history: DataFrame, symbols: list[str], calendar: Calendar, vol_cap: float = 0.30, lookback: int = 36,
                  min_obs: int = 24, periods_per_year: int = 12, w_max: float = 1.0, run: str = "mean_variance") -> DataFrame:
    """M7: equal weight on dates with too little history."""
    rows = moments(history, symbols, calendar, lookback, min_obs, periods_per_year)
    return _spread(_solved(rows, vol_cap, w_max), symbols, run)


def _solved(rows: DataFrame, vol_cap: float, w_max: float) -> DataFrame:
    """A null mean, on a thin date, gives null weights."""
    mu = F.when(F.col("n") > 0, F.col("mu"))
    return rows.select("k", best_weights(mu, F.col("cov"), F.lit(float(vol_cap)), F.lit(float(w_max))).alias("w"))


# Name, lookback, volatility cap and budget share of the default horizons.
HORIZONS = [("short", 12, 0.20, 0.25), ("medium", 36, 0.30, 0.50), ("long", 60, 0.35, 0.25)]


def multi_horizon(history: DataFrame, symbols: list[str], calendar: Calendar, horizons=HORIZONS, min_obs: int = 24,
                  periods_per_year: int = 12, run: str = "multi_horizon") -> DataFrame:
    """M8: one M7 per horizon, mixed by budget share; a horizon with too little history is equal weight."""
    if not horizons or sum(h[3] for h in horizons) <= 0:
        raise ValueError("at least one horizon needs a positive budget")
    total, size = sum(h[3] for h in horizons), len(symbols)
    rows = horizon_moments(history, symbols, calendar, [h[1] for h in horizons], min_obs, periods_per_year)
    caps = F.get(F.array(*[F.lit(float(h[2])) for h in horizons]), F.col("horizon"))
    shares = F.get(F.array(*[F.lit(h[3] / total) for h in horizons]), F.col("horizon"))
    solved = rows.select("k", shares.alias("share"), best_weights(F.col("mu"), F.col("cov"), caps, F.lit(1.0)).alias("w"))
    equal = F.array(*[F.lit(1.0 / size) for _ in symbols])
    book = solved.select("k", "share", F.coalesce("w", equal).alias("w"))
    mixed = book.groupBy("k").agg(F.array(*[F.sum(F.col("share") * F.get("w", F.lit(i))) for i in range(size)]).alias("w"))
    whole = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
    return _spread(mixed.withColumn("w", F.transform("w", lambda x: x / whole)), symbols, run)


def diagonal_allocation(estimates: DataFrame, symbols: list[str], vol_cap: float = 0.30, w_max: float = 1.0,
                        mean: str = "expected_return", run: str = "forecast_allocation") -> DataFrame:
    """Estimates with independent risks; any degraded symbol turns the date into equal weight.

    Without a weight limit the held symbols are those of highest mean, so the best weights lie
    among as many candidates as there are symbols, each known from running sums over the means
    in order (``water_levels``). With one, the critical line is followed.
    """
    mine = estimates.filter(F.col("symbol").isin(symbols)).select("k", "symbol", F.col(mean).alias("mu"), F.col("volatility").alias("sigma"), "status")
    if w_max < 1.0:
        return _limited_diagonal(mine, symbols, vol_cap, w_max, run)
    date = Window.partitionBy("k")
    sound = (F.sum(F.when(F.col("status") == "ok", 1).otherwise(0)).over(date) == len(symbols)) & (F.count("*").over(date) == len(symbols))
    marked = mine.select("*", sound.alias("sound"))
    optimal = water_levels(marked.filter("sound"), vol_cap).select("k", "symbol", "weight")
    equal = marked.filter("not sound").select("k").distinct().select("k", F.explode(F.array(*[F.lit(s) for s in symbols])).alias("symbol"), F.lit(1.0 / len(symbols)).alias("weight"))
    return optimal.unionByName(equal).select(F.lit(run).alias("run"), "k", "symbol", "weight").select(*COLUMNS)


def water_levels(rows: DataFrame, vol_cap: float) -> DataFrame:
    """(k, symbol, mu, sigma, weight, regime): best weights of (k, symbol, mu, sigma) with independent risks.

    At tilt t and level g a weight is max(t * mu + g, 0) / sigma^2. Over the first symbols by
    mean, with A, B and C the sums of 1, mu and mu^2 over sigma^2, the sum of weights fixes g and
    the cap fixes t: t^2 = (cap^2 - 1/A) / (C - B^2/A). Of the candidates whose least weight is
    not negative the one of highest return is the optimum; with none the cap cannot be met and
    the least variance, t = 0 over all symbols, is taken.
    """
    date = Window.partitionBy("k")
    ordered = date.orderBy(F.desc("mu"), "symbol")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    precision = 1.0 / (F.col("sigma") * F.col("sigma"))
    sums = rows.select("*", F.row_number().over(ordered).alias("place"), F.first("mu").over(upto).alias("top"), F.sum(precision).over(upto).alias("a"),
                       F.sum(F.col("mu") * precision).over(upto).alias("b"))
    # the spread of means around their weighted mean, from the first mean on, loses no digits where they are close
    gap = F.col("mu") - F.col("top")
    sums = sums.select("*", F.sum(gap * precision).over(upto).alias("gb"), F.sum(gap * gap * precision).over(upto).alias("gc"))
    spread = F.when(F.col("top") == F.col("mu"), 0.0).otherwise(F.greatest(F.col("gc") - F.col("gb") * F.col("gb") / F.col("a"), F.lit(0.0)))
    room = F.lit(float(vol_cap) ** 2) - 1.0 / F.col("a")
    tilt = F.when(spread > 0, F.sqrt(F.greatest(room, F.lit(0.0)) / spread)).otherwise(0.0)
    told = sums.withColumn("tilt", tilt).withColumn("spread", spread).withColumn("room", room)
    least = 1.0 / F.col("a") + F.col("tilt") * (gap - F.col("gb") / F.col("a"))
    gained = F.col("b") / F.col("a") + F.col("tilt") * F.col("spread")
    fits = (F.col("room") >= 0) & (least >= -1e-12 / F.col("a"))
    candidate = F.struct(gained.alias("gain"), (-F.col("place")).alias("first"), "a", "gb", "tilt")
    picked = told.select("k", "symbol", "mu", "sigma", "place", "top", F.max(F.when(fits, candidate)).over(date).alias("best"),
                         F.sum(precision).over(date).alias("whole"))
    inside = F.col("place") <= -F.col("best.first")
    share = (1.0 / F.col("best.a") + F.col("best.tilt") * (gap - F.col("best.gb") / F.col("best.a"))) * precision
    weight = F.when(F.col("best").isNull(), precision / F.col("whole")).when(inside, F.greatest(share, F.lit(0.0))).otherwise(0.0)
    regime = F.when(F.col("best").isNull(), "least_variance").when((F.col("best.first") == -1), "corner").otherwise("cap")
    return picked.select("k", "symbol", "mu", "sigma", weight.alias("weight"), regime.alias("regime"))


def _limited_diagonal(mine: DataFrame, symbols: list[str], vol_cap: float, w_max: float, run: str) -> DataFrame:
    def per_symbol(name):
        return F.array(*[F.max(F.when(F.col("symbol") == s, F.col(name))) for s in symbols])

    rows = mine.groupBy("k").agg(
        per_symbol("mu").alias("mu"), per_symbol("sigma").alias("sigma"),
        F.when(F.bool_and(F.col("status") == "ok") & (F.count("*") == len(symbols)), 1).otherwise(0).alias("n"))
    size = len(symbols)
    square = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.when(
        i % (size + 1) == 0, F.pow(F.get(F.col("sigma"), (i / (size + 1)).cast("int")), F.lit(2.0))).otherwise(0.0))
    return _spread(_solved(rows.withColumn("cov", square), vol_cap, w_max), symbols, run)


# -- search over a table of candidate portfolios ------------------------------


def candidates(symbols: list[str], step: float = 0.05, w_max: float = 1.0) -> list[list[float]]:
    """Corners, pairs on a grid and equal weight, in a fixed order; the size follows the symbol list."""
    n, ticks = len(symbols), round(1.0 / step)
    out = [[1.0 if i == j else 0.0 for j in range(n)] for i in range(n)]
    for i, j in combinations(range(n), 2):
        out += [[t / ticks if x == i else 1.0 - t / ticks if x == j else 0.0 for x in range(n)] for t in range(1, ticks)]
    out.append([1.0 / n] * n)
    return [w for w in out if max(w) <= w_max + 1e-12]


def candidate_search(moment_rows: DataFrame, symbols: list[str], table: list[list[float]], vol_cap: float) -> DataFrame:
    """(k, candidate, expected_return, variance): best feasible candidate, else the least variance."""
    n = len(symbols)
    options = F.array(*[F.array(*[F.lit(float(x)) for x in w]) for w in table])
    rows = moment_rows.filter("n > 0").select("k", "mu", "cov", F.posexplode(options).alias("candidate", "w"))
    mean = F.aggregate(F.zip_with("mu", "w", lambda m, x: m * x), F.lit(0.0), lambda s, x: s + x)
    cells = F.transform(F.col("cov"), lambda c, i: c * F.get(F.col("w"), (i / n).cast("int")) * F.get(F.col("w"), i % n))
    variance = F.aggregate(cells, F.lit(0.0), lambda s, x: s + x)
    scored = rows.select("k", "candidate", "w", mean.alias("expected_return"), variance.alias("variance"))
    fits = F.col("variance") <= vol_cap ** 2
    best = F.max(F.when(fits, F.struct("expected_return", (-F.col("candidate")).alias("first"), "candidate", "variance", "w")))
    calm = F.min(F.struct("variance", "candidate", "expected_return", "w"))
    picked = scored.groupBy("k").agg(best.alias("b"), calm.alias("c"))
    return picked.select("k", *[F.coalesce(F.col(f"b.{x}"), F.col(f"c.{x}")).alias(x) for x in ("candidate", "expected_return", "variance", "w")])


def candidate_weights(moment_rows: DataFrame, symbols: list[str], vol_cap: float, step: float = 0.05,
                      run: str = "candidate_search") -> DataFrame:
    found = candidate_search(moment_rows, symbols, candidates(symbols, step), vol_cap).select("k", "w")
    return _spread(moment_rows.select("k").join(found, "k", "left"), symbols, run)
