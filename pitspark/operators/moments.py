"""Return and risk estimates per date."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import local_table
from .asof import history_asof, period_returns, present
from .calendars import Calendar

#: symbols that fit as columns of one row
WIDE = 64
#: symbols of a block where there are more
BLOCK = 64


def moments(history: DataFrame, symbols: list[str], calendar: Calendar, lookback: int = 36,
            min_obs: int = 24, periods_per_year: int = 12) -> DataFrame:
    """(k, n, mu, cov) per date for a configured list of symbols.

    Means and sample covariances of the last ``lookback`` complete-case returns,
    annualised; ``cov`` is flattened by rows. ``n`` is zero, and the arrays null, on
    a thin date.
    """
    return horizon_moments(history, symbols, calendar, [lookback], min_obs, periods_per_year).drop("horizon")


def horizon_moments(history: DataFrame, symbols: list[str], calendar: Calendar, lookbacks: list[int],
                    min_obs: int = 24, periods_per_year: int = 12) -> DataFrame:
    """A9 for several lookbacks in one pass: (k, horizon, n, mu, cov), horizon an index into them.

    Up to ``WIDE`` symbols each becomes a column first, so the covariances are aggregates over
    one row per event date; more of them are cut into blocks (``block_moments``), and only the
    finished matrix of a date is put together.
    """
    if len(symbols) > WIDE:
        return _from_blocks(history, symbols, calendar, lookbacks, min_obs, periods_per_year)
    columns = [f"s{i}" for i in range(len(symbols))]
    wide = history.groupBy("k", "event_date").agg(
        *[F.max(F.when(F.col("symbol") == s, F.col("close"))).alias(c) for s, c in zip(symbols, columns)])
    for c in columns:
        wide = wide.filter(present(F.col(c)))
    # newest first: rank and the close before come from one sort
    back = Window.partitionBy("k").orderBy(F.desc("event_date"))
    rets = wide.select("k", F.row_number().over(back).alias("rank"),
                       *[(F.col(c) / F.lead(c).over(back) - 1.0).alias(c) for c in columns])
    reach = [F.when(F.col("rank") <= n, F.lit(i)) for i, n in enumerate(lookbacks)]
    rets = rets.filter(F.col(columns[0]).isNotNull()).withColumn(
        "horizon", F.explode(F.filter(F.array(*reach), lambda h: h.isNotNull())))
    pairs = {}
    for i, a in enumerate(columns):
        for j, b in enumerate(columns[i:], i):
            pairs[(i, j)] = F.covar_samp(a, b) * periods_per_year
    stats = rets.groupBy("k", "horizon").agg(
        F.count("*").alias("n"),
        F.array(*[F.avg(c) * periods_per_year for c in columns]).alias("mu"),
        F.array(*[pairs[tuple(sorted((i, j)))] for i in range(len(columns)) for j in range(len(columns))]).alias("cov"))
    enough = F.col("n") >= min_obs
    dates = calendar.frame(history.sparkSession).select("k", F.explode(F.sequence(F.lit(0), F.lit(len(lookbacks) - 1))).alias("horizon"))
    return dates.join(stats, ["k", "horizon"], "left").select(
        "k", "horizon", F.when(enough, F.col("n")).otherwise(0).alias("n"),
        F.when(enough, F.col("mu")).alias("mu"), F.when(enough, F.col("cov")).alias("cov"))


def block_moments(history: DataFrame, symbols: DataFrame, lookbacks: list[int], min_obs: int = 24, periods_per_year: int = 12,
                  block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """A9 for any number of symbols, a table (symbol): means (k, horizon, symbol, n, mu) and covariances (k, horizon, s1, s2, covariance).

    A symbol's returns on a date are one array, dealt by hash into blocks of about ``block``
    symbols. Two blocks of a date meet in a row of their own, keyed by date and both blocks,
    and become a product of two small matrices there; no task sees a date whole, and what is
    shuffled is one array per symbol and block. Dates with fewer than ``min_obs`` returns give no rows.
    ``history`` has one row per (k, symbol, event_date), so a period is whole by its number of rows.
    """
    names = symbols.select("symbol").filter("symbol is not null").distinct()
    size = names.count()
    blocks = max(1, -(-size // block))
    mine = history.filter(present(F.col("close"))).join(names, "symbol", "left_semi")
    whole = mine.groupBy("k", "event_date").agg(F.count("*").alias("n")).filter(F.col("n") == size)
    # one row per date and period: ranks are the same for all symbols
    ranked = whole.select("k", "event_date", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("event_date"))).alias("rank"))
    kept = ranked.filter(F.col("rank") <= max(lookbacks) + 1)
    series = mine.join(kept, ["k", "event_date"]).groupBy("k", "symbol").agg(F.sort_array(F.collect_list(F.struct("rank", "close"))).alias("c"))
    rets = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.get("c", i - 1)["close"] / F.get("c", i)["close"] - 1.0)
    series = series.filter(F.size("c") > 1).select("k", "symbol", rets.alias("r"), F.pmod(F.hash("symbol"), F.lit(blocks)).alias("b"))
    horizon = F.explode(F.array(*[F.struct(F.lit(i).alias("horizon"), F.lit(n).alias("reach")) for i, n in enumerate(lookbacks)])).alias("h")
    own = series.select("k", "symbol", "r", horizon).select("k", "h.horizon", "symbol", F.slice("r", 1, F.col("h.reach")).alias("r"))
    total = F.aggregate("r", F.lit(0.0), lambda s, x: s + x)
    means = own.filter(F.size("r") >= min_obs).select("k", "horizon", "symbol", F.size("r").cast("long").alias("n"), (total / F.size("r") * periods_per_year).alias("mu"))

    packed = series.groupBy("k", "b").agg(F.collect_list(F.struct("symbol", "r")).alias("rows"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    sides = packed.select("k", "b", "rows", other)
    first = sides.filter("b <= other").select("k", F.col("b").alias("lo"), F.col("other").alias("hi"), F.col("rows").alias("left"))
    second = sides.filter("b >= other").select("k", F.col("other").alias("lo"), F.col("b").alias("hi"), F.col("rows").alias("right"))
    met = first.join(second, ["k", "lo", "hi"])
    return means, met.mapInArrow(_products(lookbacks, min_obs, periods_per_year), "k int, horizon int, s1 string, s2 string, covariance double")


def _products(lookbacks: list[int], min_obs: int, periods_per_year: int):
    """Sample covariances of two blocks of a date, both ways round where the blocks differ."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                (s1, a), (s2, b) = (([x["symbol"] for x in side], np.array([x["r"] for x in side], float)) for side in (row["left"], row["right"]))
                for horizon, reach in enumerate(lookbacks):
                    x, y = a[:, :reach], b[:, :reach]
                    n = x.shape[1]
                    if n < max(min_obs, 2):
                        continue
                    table = (x - x.mean(1, keepdims=True)) @ (y - y.mean(1, keepdims=True)).T / (n - 1) * periods_per_year
                    for left, right, values in [(s1, s2, table), *([] if row["lo"] == row["hi"] else [(s2, s1, table.T)])]:
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(values.size, row["k"], np.int32)), pa.array(np.full(values.size, horizon, np.int32)),
                            pa.array(np.repeat(np.array(left, object), len(right)), pa.string()), pa.array(np.tile(np.array(right, object), len(left)), pa.string()),
                            pa.array(np.ascontiguousarray(values).ravel())], ["k", "horizon", "s1", "s2", "covariance"])

    return run


def _from_blocks(history: DataFrame, symbols: list[str], calendar: Calendar, lookbacks: list[int], min_obs: int, periods_per_year: int) -> DataFrame:
    """(k, horizon, n, mu, cov) as arrays in the order of ``symbols``, a matrix row at a time."""
    spark = history.sparkSession
    names = local_table(spark, [(s, i) for i, s in enumerate(symbols)], "symbol string, place int")
    means, covariances = block_moments(history, names, lookbacks, min_obs, periods_per_year)
    mu = means.join(names, "symbol").groupBy("k", "horizon").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "mu"))).alias("mu"))
    inner = covariances.join(names.select(F.col("symbol").alias("s2"), F.col("place").alias("column")), "s2").groupBy("k", "horizon", "s1").agg(
        F.sort_array(F.collect_list(F.struct("column", "covariance"))).alias("row"))
    cov = inner.join(names.select(F.col("symbol").alias("s1"), "place"), "s1").groupBy("k", "horizon").agg(
        F.sort_array(F.collect_list(F.struct("place", F.col("row.covariance").alias("row")))).alias("cov"))
    dates = calendar.frame(spark).select("k", F.explode(F.sequence(F.lit(0), F.lit(len(lookbacks) - 1))).alias("horizon"))
    found = dates.join(mu, ["k", "horizon"], "left").join(cov, ["k", "horizon"], "left")
    return found.select("k", "horizon", F.coalesce("n", F.lit(0)).alias("n"), F.col("mu.mu").alias("mu"), F.flatten("cov.row").alias("cov"))


def covariance_rows(moment_rows: DataFrame, symbols: list[str]) -> DataFrame:
    """A9 long: (k, s1, s2, covariance)."""
    names = F.array(*[F.lit(s) for s in symbols])
    flat = moment_rows.filter("n > 0").select("k", F.posexplode("cov").alias("i", "covariance"))
    row, column = (F.col("i") / len(symbols)).cast("int"), F.col("i") % len(symbols)
    return flat.select("k", F.get(names, row).alias("s1"), F.get(names, column).alias("s2"), "covariance")


def _own_returns(prices: DataFrame, calendar: Calendar, lookback: int) -> DataFrame:
    return period_returns(history_asof(prices, calendar, last=lookback + 1, exact=False), lookback)


def _with_missing(stats: DataFrame, symbols: DataFrame, calendar: Calendar) -> DataFrame:
    last = F.lit(len(calendar) - 1)
    grid = symbols.select("symbol").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    return grid.join(stats, ["symbol", "k"], "left")


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def return_risk(prices: DataFrame, symbols: DataFrame, calendar: Calendar, lookback: int = 36, min_obs: int = 24,
                periods_per_year: int = 12, floor: float = 1e-9) -> DataFrame:
    """A10: (k, symbol, expected_return, volatility, observations, status) from each symbol's own prices."""
    stats = _own_returns(prices, calendar, lookback).groupBy("symbol", "k").agg(
        F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("std"))
    expected, volatility = F.col("mean") * periods_per_year, F.col("std") * math.sqrt(periods_per_year)
    ok = F.coalesce((F.col("n") >= min_obs) & _finite(expected) & _finite(volatility), F.lit(False))
    return _with_missing(stats, symbols, calendar).select(
        "k", "symbol", F.when(ok, expected).otherwise(0.0).alias("expected_return"),
        F.when(ok, F.greatest(volatility, F.lit(floor))).otherwise(0.0).alias("volatility"),
        F.coalesce("n", F.lit(0)).alias("observations"), F.when(ok, "ok").otherwise("degraded").alias("status"))


def downside_risk(prices: DataFrame, symbols: DataFrame, calendar: Calendar, lookback: int = 36, min_obs: int = 24,
                  periods_per_year: int = 12, penalty: float = 1.0, floor: float = 1e-6) -> DataFrame:
    """A10 plus the downside semideviation and the mean return penalised by it."""
    stats = _own_returns(prices, calendar, lookback).groupBy("symbol", "k").agg(
        F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("std"),
        F.sqrt(F.coalesce(F.avg(F.when(F.col("ret") < 0, F.col("ret") * F.col("ret"))), F.lit(0.0))).alias("semi"))
    root = math.sqrt(periods_per_year)
    mean, volatility, semi = F.col("mean") * periods_per_year, F.col("std") * root, F.col("semi") * root
    ok = F.coalesce((F.col("n") >= min_obs) & _finite(mean) & _finite(volatility) & _finite(semi), F.lit(False))

    def known(c):
        return F.when(ok, c).otherwise(0.0)

    return _with_missing(stats, symbols, calendar).select(
        "k", "symbol", known(mean).alias("mean_return"), known(semi).alias("downside_semideviation"),
        known(mean - penalty * semi).alias("adjusted_return"),
        known(F.greatest(volatility, F.lit(floor))).alias("volatility"),
        F.coalesce("n", F.lit(0)).alias("observations"), F.when(ok, "ok").otherwise("degraded").alias("status"))
