"""Backtest spine: legs, turnover, returns, metrics and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import trading_cost
from ..operators import asof, metrics, weights
from ..operators.backtest import Backtest, Costs, on_legs, portfolio_returns, run_backtest, turnover_parts
from ..operators.calendars import WalkForward
from ..session import local_table
from . import base
from .base import D, METRIC_SQL, MONTHLY, backtest_blocks, cte, day, metric_output, metrics_blocks, query, r, rd, sql

COSTS = Costs(commission_bps=10, slippage_bps=5, tw_transaction_tax_bps=30)
PLAN = WalkForward(36, 12, 12)
CONFIG = Backtest(MONTHLY, "monthly", "net", COSTS, PLAN)
STATIC = [("1-URGENT", 3.0), ("2-HIGH", 1.0), ("3-MEDIUM", -2.0), ("5-LOW", 1.0)]

cte("w_equal", """SELECT 'equal_weight' AS run, k, symbol, 1.0 / (SELECT count(*) FROM supplier) AS weight
    FROM cal, (SELECT CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier)""", ["cal", "prices"])
cte("u_raw", """SELECT k, symbol, CAST(('0x' || substr(md5('7|' || strftime(as_of, '%Y-%m-%d') || '|' || symbol), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 AS u
    FROM cal, (SELECT CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier)""", ["cal", "prices"])
cte("w_random", "SELECT 'random' AS run, k, symbol, u / sum(u) OVER (PARTITION BY k) AS weight FROM u_raw", ["u_raw"])
cte("iu_raw", """SELECT k, symbol, CAST(('0x' || substr(md5('7|' || strftime(as_of, '%Y-%m-%d') || '|' || symbol), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 AS u
    FROM cal, (SELECT DISTINCT symbol FROM index_prices)""", ["cal", "index_prices"])
cte("wi_random", "SELECT 'random' AS run, k, symbol, u / sum(u) OVER (PARTITION BY k) AS weight FROM iu_raw", ["iu_raw"])
cte("wi_equal", """SELECT 'equal_weight' AS run, k, symbol, 1.0 / (SELECT count(DISTINCT symbol) FROM index_prices) AS weight
    FROM cal, (SELECT DISTINCT symbol FROM index_prices)""", ["cal", "index_prices"])
cte("wi_static", """SELECT 'static' AS run, k, symbol, greatest(w, 0) / 5.0 AS weight
    FROM cal, (VALUES ('1-URGENT', 3.0::DOUBLE), ('2-HIGH', 1.0), ('3-MEDIUM', -2.0), ('5-LOW', 1.0)) AS t(symbol, w)""", ["cal"])
cte("wi_sma", """SELECT 'sma_timing' AS run, c.k, s.symbol, CASE WHEN n IS NULL THEN 0.0 WHEN n < 6 THEN 1.0 WHEN last > mean THEN 1.0 ELSE 0.0 END / 5.0 AS weight
    FROM cal c CROSS JOIN (SELECT DISTINCT symbol FROM index_prices) s LEFT JOIN (
      SELECT k, symbol, count(*) AS n, avg(close) AS mean, arg_max(close, event_date) AS last FROM (
        SELECT *, row_number() OVER (PARTITION BY k, symbol ORDER BY event_date DESC) AS rn FROM index_hist) WHERE rn <= 6 GROUP BY k, symbol) h
    ON h.k = c.k AND h.symbol = s.symbol""", ["cal", "index_hist"])
cte("wi_all", "SELECT * FROM wi_equal UNION ALL SELECT * FROM wi_static UNION ALL SELECT * FROM wi_random UNION ALL SELECT * FROM wi_sma",
    ["wi_equal", "wi_static", "wi_random", "wi_sma"])


def index_weights(spark, d):
    """Four strategies on the index panel as one weights table."""
    px = base.index_prices(spark, d)
    names = base.assets(spark)
    static = local_table(spark, STATIC, "symbol string, weight double")
    sma = weights.sma_timing(px, names, MONTHLY, 6).withColumn("weight", F.col("weight") / 5.0)
    return (weights.equal_weight(names, MONTHLY).unionByName(weights.static_weights(static, MONTHLY))
            .unionByName(weights.random_weights(names, MONTHLY, 7)).unionByName(sma))


def index_runs(spark):
    return local_table(spark, [("equal_weight",), ("static",), ("random",), ("sma_timing",)], "run string")


@query("b1_equal_weight_backtest", sql("w_equal legs seg", f"SELECT run, segment, 'net' AS basis, {METRIC_SQL} FROM metric",
                                       **backtest_blocks("w_equal", "legs", 45)))
def _(spark, d):
    px = base.prices(spark, d)
    _, m = run_backtest(weights.equal_weight(base.suppliers(spark, d), MONTHLY), px, CONFIG, local_table(spark, [("equal_weight",)], "run string"))
    return metric_output(m, "run", "segment", "basis")


@query("b1_random_weight_backtest", sql("w_random legs seg", f"SELECT run, segment, {METRIC_SQL} FROM metric",
                                        **backtest_blocks("w_random", "legs", 45)))
def _(spark, d):
    px = base.prices(spark, d)
    _, m = run_backtest(weights.random_weights(base.suppliers(spark, d), MONTHLY, 7), px, CONFIG)
    return metric_output(m, "run", "segment")


@query("j7_price_legs", sql("legs", f"SELECT CAST(k AS BIGINT) AS k, symbol, {rd('leg', 9)} AS leg FROM legs"))
def _(spark, d):
    legs = asof.price_legs(base.prices(spark, d), MONTHLY).filter("leg is not null")
    return legs.select(F.col("k").cast("long").alias("k"), "symbol", r("leg", 9).alias("leg"))


@query("j7_weights_on_legs", sql("w_random legs", f"""
    SELECT CAST(k AS BIGINT) AS k, count(*) AS legs, {rd('sum(weight * leg)', 9)} AS gross FROM w_random JOIN legs USING (k, symbol) GROUP BY k"""))
def _(spark, d):
    px = base.prices(spark, d)
    joined = on_legs(weights.random_weights(base.suppliers(spark, d), MONTHLY, 7), asof.price_legs(px, MONTHLY))
    return joined.groupBy(F.col("k").cast("long").alias("k")).agg(
        F.count("*").alias("legs"), r(F.sum(F.col("weight") * F.col("leg")), 9).alias("gross"))


@query("j8_turnover", sql("wi_all", f"SELECT run, CAST(k AS BIGINT) AS k, {rd('turnover', 9)} AS turnover FROM port WHERE turnover > 1e-12",
                          **{k: v for k, v in backtest_blocks("wi_all", "index_legs", 45).items() if k in ("b_runs", "b_turn")},
                          port="SELECT run, k, turnover FROM b_turn WHERE k <= (SELECT max(k) FROM cal)"))
def _(spark, d):
    parts = turnover_parts(index_weights(spark, d), len(MONTHLY))
    return parts.groupBy("run", F.col("k").cast("long").alias("k")).agg(F.sum("turnover").alias("t")).filter("t > 1e-12").select(
        "run", "k", r("t", 9).alias("turnover"))


@query("a2_portfolio_returns", sql("wi_all index_legs seg", f"""
    SELECT run, CAST(k AS BIGINT) AS k, {rd('turnover', 9)} AS turnover, {rd('ret', 9)} AS ret FROM port""",
    **backtest_blocks("wi_all", "index_legs", 45)))
def _(spark, d):
    legs = asof.price_legs(base.index_prices(spark, d), MONTHLY)
    out = portfolio_returns(index_weights(spark, d), legs, len(MONTHLY), COSTS.charged_bps, index_runs(spark))
    return out.select("run", F.col("k").cast("long").alias("k"), r("turnover", 9).alias("turnover"), r("ret", 9).alias("ret"))


@query("f1_trading_cost", sql("", f"""
    SELECT l_returnflag, l_linestatus, {rd('sum(greatest(0, l_discount - 0.02) * (l_tax * 100 + 5 + 30) / 10000.0)')} AS cost FROM lineitem GROUP BY 1, 2"""))
def _(spark, d):
    cost = trading_cost(F.col("l_discount") - 0.02, F.col("l_tax") * 100 + 5 + 30)
    return base.table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(r(F.sum(cost)).alias("cost"))


@query("a1_metrics", sql("wi_all index_legs seg", f"SELECT run, segment, {METRIC_SQL} FROM metric WHERE segment = 'full'",
                         **backtest_blocks("wi_all", "index_legs", 45)))
def _(spark, d):
    _, m = run_backtest(index_weights(spark, d), base.index_prices(spark, d), CONFIG, index_runs(spark))
    return metric_output(m.filter("segment = 'full'"), "run", "segment")


@query("a3_segment_metrics", sql("wi_all index_legs seg", f"SELECT run, segment, {METRIC_SQL} FROM metric WHERE segment <> 'full'",
                                 **backtest_blocks("wi_all", "index_legs", 45)))
def _(spark, d):
    _, m = run_backtest(index_weights(spark, d), base.index_prices(spark, d), CONFIG, index_runs(spark))
    return metric_output(m.filter("segment <> 'full'"), "run", "segment")


@query("a19_flat_guard", sql("wi_all index_legs seg", f"""
    SELECT {rd('max(annualized_vol)')} AS max_oos_vol, CASE WHEN max(annualized_vol) < 1e-6 THEN 'degenerate' ELSE 'computed' END AS status
    FROM metric WHERE segment = 'out_of_sample'""", **backtest_blocks("wi_all", "index_legs", 45)))
def _(spark, d):
    _, m = run_backtest(index_weights(spark, d), base.index_prices(spark, d), CONFIG, index_runs(spark))
    return metrics.flat_guard(m).select(r("max_oos_vol").alias("max_oos_vol"), "status")


# -- return tables straight from the panel: one series per supplier or asset ---

cte("series", "SELECT symbol AS run, k, leg AS ret FROM legs", ["legs"])
cte("iseries", "SELECT symbol AS run, k, leg AS ret FROM index_legs", ["index_legs"])
cte("equity", """SELECT run, k, ret, wealth AS equity, wealth / max(wealth) OVER (PARTITION BY run ORDER BY k ROWS UNBOUNDED PRECEDING) - 1 AS drawdown
    FROM (SELECT *, product(1 + ret) OVER (PARTITION BY run ORDER BY k ROWS UNBOUNDED PRECEDING) AS wealth FROM series)""", ["series"])


def series(spark, d):
    legs = asof.price_legs(base.prices(spark, d), MONTHLY).filter("leg is not null")
    return legs.select(F.col("symbol").alias("run"), "k", F.col("leg").alias("ret"))


def equity(spark, d):
    return metrics.wealth_path(series(spark, d), ["run"]).withColumnRenamed("wealth", "equity")


@query("w1_period_returns", sql("hist", f"""
    SELECT CAST(k AS BIGINT) AS k, symbol, count(*) AS n, {rd('sum(ret)')} AS total FROM (
      SELECT k, symbol, close / lag(close) OVER (PARTITION BY k, symbol ORDER BY event_date) - 1 AS ret FROM hist) WHERE ret IS NOT NULL GROUP BY k, symbol"""))
def _(spark, d):
    rets = asof.period_returns(asof.history_asof(base.prices(spark, d), MONTHLY))
    return rets.groupBy(F.col("k").cast("long").alias("k"), "symbol").agg(F.count("*").alias("n"), r(F.sum("ret")).alias("total"))


@query("w2_wealth_path", sql("equity", f"SELECT run, CAST(k AS BIGINT) AS k, {rd('equity')} AS wealth FROM equity"))
def _(spark, d):
    return equity(spark, d).select("run", F.col("k").cast("long").alias("k"), r("equity").alias("wealth"))


@query("w3_drawdown_path", sql("equity", f"SELECT run, CAST(k AS BIGINT) AS k, {rd('drawdown')} AS drawdown FROM equity"))
def _(spark, d):
    return equity(spark, d).select("run", F.col("k").cast("long").alias("k"), r("drawdown").alias("drawdown"))


@query("w4_rolling_sharpe", sql("series", f"""
    SELECT run, CAST(k AS BIGINT) AS k, {rd('CASE WHEN std > 1e-12 THEN mean / std * sqrt(12.0) ELSE 0 END')} AS rolling_sharpe FROM (
      SELECT run, k, row_number() OVER (PARTITION BY run ORDER BY k) AS rn, count(*) OVER (PARTITION BY run) AS n,
        avg(ret) OVER f AS mean, stddev_pop(ret) OVER f AS std FROM series WINDOW f AS (PARTITION BY run ORDER BY k ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
    WHERE rn >= greatest(2, least(12, n))"""))
def _(spark, d):
    return metrics.rolling_sharpe(series(spark, d), ["run"], 12, 12).select("run", F.col("k").cast("long").alias("k"), r("rolling_sharpe").alias("rolling_sharpe"))


@query("w13_returns_from_equity", sql("equity", f"""
    SELECT 'payload' AS version, run, CAST(k AS BIGINT) AS k, {rd('e / p - 1')} AS ret FROM (SELECT run, k, equity AS e, lag(equity) OVER (PARTITION BY run ORDER BY k) AS p FROM equity) WHERE p IS NOT NULL
    UNION ALL SELECT 'chart', run, CAST(k AS BIGINT), {rd('e / p - 1')} FROM (SELECT run, k, equity AS e, lag(equity, 1, 1.0) OVER (PARTITION BY run ORDER BY k) AS p FROM equity)"""))
def _(spark, d):
    path = equity(spark, d).select("run", "k", "equity")
    payload = metrics.returns_from_equity(path, ["run"]).withColumn("version", F.lit("payload"))
    chart = metrics.returns_from_equity(path, ["run"], 1.0).withColumn("version", F.lit("chart"))
    return payload.unionByName(chart).select("version", "run", F.col("k").cast("long").alias("k"), r("ret").alias("ret"))


@query("a12_distribution", sql("series", f"""
    SELECT run, count(*) AS observations, {rd('avg(ret)')} AS mean, {rd('stddev_pop(ret)')} AS volatility,
      {rd('avg(pow((ret - m) / s, 3))', 5)} AS skew, {rd('avg(pow((ret - m) / s, 4)) - 3', 5)} AS excess_kurtosis, {rd('-quantile_cont(ret, 0.05)')} AS var_5pct
    FROM (SELECT run, ret, avg(ret) OVER (PARTITION BY run) AS m, stddev_pop(ret) OVER (PARTITION BY run) AS s FROM series) GROUP BY run"""))
def _(spark, d):
    return metrics.distribution(series(spark, d), ["run"]).select(
        "run", "observations", r("mean").alias("mean"), r("volatility").alias("volatility"), r("skew", 5).alias("skew"),
        r("excess_kurtosis", 5).alias("excess_kurtosis"), r("var_5pct").alias("var_5pct"))


@query("a18_histogram", sql("series", """
    SELECT run, CAST(least(15, floor((ret - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END * 16)) AS BIGINT) AS bin, count(*) AS n
    FROM (SELECT *, min(ret) OVER (PARTITION BY run) AS lo, max(ret) OVER (PARTITION BY run) AS hi FROM series) GROUP BY 1, 2"""))
def _(spark, d):
    return metrics.histogram(series(spark, d), ["run"]).select("run", F.col("bin").cast("long").alias("bin"), "n")


@query("a22_growth", sql("equity", f"""
    SELECT run, {rd('CASE WHEN final <= 0 THEN -1.0 ELSE pow(final, 12.0 / n) - 1 END')} AS cagr, {rd('dd')} AS max_drawdown
    FROM (SELECT run, arg_max(equity, k) AS final, count(*) AS n, min(drawdown) AS dd FROM equity GROUP BY run)"""))
def _(spark, d):
    return metrics.growth(equity(spark, d), ["run"], 12).select("run", r("cagr").alias("cagr"), r("max_drawdown").alias("max_drawdown"))
