"""Augmented Dickey-Fuller test of many series at once, with the lag order chosen by AIC.

A series is one row, an array in order of time. Its regressors are the constant, the level
before, and the changes before; all that the test needs of them is their Gram matrix.
Eliminating it column by column gives, after each added lag, the residual sum of squares, so
one elimination per series serves every lag order.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

# workers get the test with the task, so they need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELLS = 1 << 23
#: a column this much shorter than it was depends on those before it
DEPENDENT = 1e-12


def most_lags(n: int) -> int:
    """Schwert's rule, with as many degrees of freedom left as the sample needs; negative where it is too short."""
    return min(n // 2 - 2, int(np.ceil(12.0 * (n / 100.0) ** 0.25)))


def _gram(levels: np.ndarray, lags: int, level_last: bool) -> np.ndarray:
    """(series, p, p): products of constant, level, lagged changes and, at the end, the change itself."""
    n = levels.shape[1]
    changes = np.diff(levels, axis=1)
    level = levels[:, lags:n - 1]
    before = [changes[:, lags - j:n - 1 - j] for j in range(1, lags + 1)]
    columns = [np.ones_like(level), *([*before, level] if level_last else [level, *before]), changes[:, lags:]]
    table = np.stack(columns, 1)
    return table @ table.transpose(0, 2, 1)


def _eliminate(gram: np.ndarray, columns: int):
    """After each column taken out: what is left of the matrix, and which series had no dependent column so far."""
    scale, sound = np.einsum("bii->bi", gram).copy(), np.ones(len(gram), bool)
    for c in range(columns):
        pivot = gram[:, c, c]
        sound = sound & (pivot > DEPENDENT * scale[:, c])
        factor = gram[:, :, c] / np.where(sound, pivot, 1.0)[:, None]
        gram = gram - factor[:, :, None] * gram[:, c, None, :]
        yield gram, sound


def choose_lags(levels: np.ndarray, most: int) -> np.ndarray:
    """Per series the lag order of least AIC, on the sample that all orders share; the lowest of equals, -1 if none can be fitted."""
    m = levels.shape[1] - 1 - most
    scores = []
    for used, (gram, sound) in enumerate(_eliminate(_gram(levels, most, False), most + 2), 1):
        if used >= 2:
            left = gram[:, -1, -1]
            with np.errstate(divide="ignore", invalid="ignore"):
                fit = np.where(left > 0, m * np.log(np.maximum(left, 0) / m), -np.inf)
            scores.append(np.where(sound, fit + 2.0 * used, np.inf))
    table = np.stack(scores, 1)
    return np.where(np.isfinite(table.min(1)) | (table.min(1) == -np.inf), table.argmin(1), -1)


def statistics(levels: np.ndarray, lags: int) -> np.ndarray:
    """t statistic of the level at a given lag order; NaN where it has no error."""
    m, used = levels.shape[1] - 1 - lags, lags + 2
    gram, sound = list(_eliminate(_gram(levels, lags, True), lags + 1))[-1]
    a, b, c = gram[:, -2, -2], gram[:, -2, -1], gram[:, -1, -1]
    with np.errstate(divide="ignore", invalid="ignore"):
        left = c - b * b / a
        ok = sound & (a > 0) & (left > DEPENDENT * c) & (m > used)
        return np.where(ok, b / np.sqrt(np.where(ok, left, 1.0) / max(m - used, 1) * np.where(ok, a, 1.0)), np.nan)


def test_series(series: list[np.ndarray], most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(lag, t) of each series; lag -1 and t NaN where it is too short or constant."""
    lag, t = np.full(len(series), -1), np.full(len(series), np.nan)
    sizes = np.fromiter(map(len, series), np.int64, len(series))
    for n in np.unique(sizes).tolist():
        limit = most_lags(n) if most is None else min(most, n // 2 - 2)
        if limit < 0:
            continue
        mine = np.flatnonzero(sizes == n)
        step = max(1, CELLS // (n * (limit + 3)))
        for some in (mine[i:i + step] for i in range(0, len(mine), step)):
            levels = np.stack([series[i] for i in some]).astype(float)
            flat = ~(np.isfinite(levels).all(1) & (np.ptp(levels, axis=1) > 0))
            levels[flat] = 0.0
            lag[some] = np.where(flat, -1, choose_lags(levels, limit))
            for chosen in np.unique(lag[some]).tolist():
                rows = np.flatnonzero(lag[some] == chosen)
                if chosen >= 0:
                    t[some[rows]] = statistics(levels[rows], chosen)
    return lag, t


def augmented_test(series: Column, most: int | None = None) -> Column:
    """struct(lag, t) of an array of levels in order of time."""
    @pandas_udf("struct<lag:int,t:double>")
    def run(levels: pd.Series) -> pd.DataFrame:
        lag, t = test_series(list(levels), most)
        return pd.DataFrame({"lag": pd.array(np.where(lag < 0, 0, lag), dtype="Int32").copy(), "t": t}).assign(
            lag=lambda f: f["lag"].mask(lag < 0), t=lambda f: f["t"].astype("Float64").mask(np.isnan(t)))

    return run(series)
