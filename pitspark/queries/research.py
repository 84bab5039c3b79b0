"""Universe and sufficiency, comparisons, reports and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import cadence, cadence_days, oos_net, oversampled
from ..operators import asof, metrics, pit, universe, weights
from ..operators.backtest import Costs
from ..operators.calendars import WalkForward
from ..plans import benchmarks, reports, runs
from . import base
from .base import D, METRIC_SQL, MONTHLY, backtest_blocks, cte, day, metric_output, query, r, rd, sql
from .returns import CONFIG, STATIC, index_weights
from .strategies import DEFENSIVE, RISK_ON, UNKNOWN

cte("spans", """SELECT symbol, min(event_date) AS start, max(event_date) AS "end" FROM prices WHERE NOT isnan(close) AND close > 0 GROUP BY symbol""", ["prices"])
# customers as assets: their order months give spans of many lengths
cte("cust", """SELECT CAST(o_custkey AS VARCHAR) AS symbol, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS event_date,
      CAST(o_orderdate AS TIMESTAMP) AS available_date, o_totalprice AS close FROM orders""", [])
cte("cspans", """SELECT symbol, min(event_date) AS start, max(event_date) AS "end" FROM cust GROUP BY symbol""", ["cust"])
_MONTHS = "floor((epoch_us({1}) - epoch_us({0})) / 86400000000) / 30.4375"
cte("cut", f"""SELECT s.s, count(*) AS n, max(start) AS start, min("end") AS "end", list(symbol ORDER BY symbol) AS members
    FROM (SELECT DISTINCT start AS s FROM cspans) s JOIN cspans ON start <= s AND {_MONTHS.format('s', '"end"')} >= 60 GROUP BY s.s""", ["cspans"])
cte("best_cut", f"""SELECT *, {_MONTHS.format('start', '"end"')} AS months FROM cut ORDER BY n DESC, months DESC, members DESC LIMIT 1""", ["cut"])
cte("gaps", """SELECT symbol, date_diff('day', lag(event_date) OVER (PARTITION BY symbol ORDER BY event_date), event_date) AS gap
    FROM (SELECT DISTINCT symbol, event_date FROM cust)""", ["cust"])
_CADENCE = "CASE WHEN {0} <= 0 THEN 'irregular' WHEN {0} <= 4 THEN 'daily' WHEN {0} <= 10 THEN 'weekly' WHEN {0} <= 45 THEN 'monthly' WHEN {0} <= 135 THEN 'quarterly' ELSE 'irregular' END"
cte("rhythm", f"SELECT symbol, m AS median_days, {_CADENCE.format('m')} AS cadence FROM (SELECT symbol, coalesce(median(gap), 0.0) AS m FROM gaps GROUP BY symbol)", ["gaps"])


def customer_prices(spark, d):
    return base.table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("symbol"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("event_date"),
        F.col("o_orderdate").alias("available_date"), F.col("o_totalprice").alias("close"), F.lit(False).alias("is_approximate"))


@query("a7_native_cadence", sql("rhythm", f"SELECT symbol, {rd('median_days')} AS median_days, cadence FROM rhythm"))
def _(spark, d):
    return universe.sampling(customer_prices(spark, d)).select("symbol", r("median_days").alias("median_days"), "cadence")


@query("a7_intraday_cadence", f"""
    WITH gaps AS (SELECT user_id, floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 86400000000) AS gap
      FROM (SELECT DISTINCT user_id, ts FROM events))
    SELECT CAST(user_id AS VARCHAR) AS symbol, {rd('coalesce(median(gap), 0.0)')} AS median_days, {_CADENCE.format('coalesce(median(gap), 0.0)')} AS cadence FROM gaps GROUP BY user_id""")
def _(spark, d):
    events = base.table(spark, d, "events").select(F.col("user_id").cast("string").alias("symbol"), F.col("ts").alias("event_date"))
    return universe.sampling(events).select("symbol", r("median_days").alias("median_days"), "cadence")


@query("f3_cadence_labels", sql("", f"SELECT o_orderkey AS id, {_CADENCE.format('x')} AS cadence FROM (SELECT o_orderkey, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) / 12.0 AS x FROM orders)"))
def _(spark, d):
    gap = F.date_diff("o_orderdate", F.lit("1995-01-01").cast("date")) / 12.0
    return base.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), cadence(gap).alias("cadence"))


@query("f4_oversampling", sql("rhythm", """
    SELECT rebalance, cadence, count(*) AS n, count(*) FILTER (WHERE median_days > days * 1.5) AS oversampled FROM rhythm,
      (VALUES ('daily', 1.0), ('weekly', 7.0), ('monthly', 30.4375), ('quarterly', 91.3125), ('semiannual', 30.4375)) AS t(rebalance, days) GROUP BY 1, 2"""))
def _(spark, d):
    labels = F.array(*[F.lit(x) for x in ("daily", "weekly", "monthly", "quarterly", "semiannual")])
    each = universe.sampling(customer_prices(spark, d)).withColumn("rebalance", F.explode(labels))
    flag = oversampled(F.col("median_days"), cadence_days(F.col("rebalance")))
    return each.groupBy("rebalance", "cadence").agg(F.count("*").alias("n"), F.count_if(flag).alias("oversampled"))


@query("j10_cotemporal_universe", sql("best_cut", f"""
    SELECT symbol, {D.format('start')} AS start, {D.format('"end"')} AS "end" FROM cspans WHERE symbol IN (SELECT unnest(members) FROM best_cut)"""))
def _(spark, d):
    members = universe.cotemporal_universe(pit.asset_spans(customer_prices(spark, d)), 60.0)
    return members.select("symbol", day("start").alias("start"), day("end").alias("end"))


@query("o5_best_subset", sql("best_cut", f"""
    SELECT n AS assets, {D.format('start')} AS start, {D.format('"end"')} AS "end", {rd('months')} AS months FROM best_cut"""))
def _(spark, d):
    members = universe.cotemporal_universe(pit.asset_spans(customer_prices(spark, d)), 60.0)
    return universe.shared_window(members).select("assets", day("start").alias("start"), day("end").alias("end"), r("months").alias("months"))


@query("j11_shared_window", sql("cspans", f"""
    SELECT segment, assets, {D.format('s')} AS start, {D.format('e')} AS "end", {rd('CASE WHEN e >= s THEN ' + _MONTHS.format('s', 'e') + ' ELSE -1 END')} AS months FROM (
      SELECT c_mktsegment AS segment, count(*) AS assets, max(start) AS s, min("end") AS e FROM cspans JOIN customer ON symbol = CAST(c_custkey AS VARCHAR) GROUP BY 1)"""))
def _(spark, d):
    spans = pit.asset_spans(customer_prices(spark, d))
    names = base.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("symbol"), F.col("c_mktsegment").alias("segment"))
    return universe.shared_window(spans.join(names, "symbol"), ["segment"]).select(
        "segment", "assets", day("start").alias("start"), day("end").alias("end"), r("months").alias("months"))


@query("j12_cotemporal_dates", sql("prices", f"""
    SELECT {D.format('event_date')} AS event_date FROM prices WHERE symbol IN (SELECT symbol FROM listings WHERE delist_date IS NULL)
    GROUP BY prices.event_date HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM prices WHERE symbol IN (SELECT symbol FROM listings WHERE delist_date IS NULL))""",
    listings=base._CTE["listings"]))
def _(spark, d):
    alive = base.listings(spark, d).filter("delist_date is null")
    return universe.cotemporal_dates(base.prices(spark, d), alive).select(day("event_date").alias("event_date"))


@query("j13_episodes_in_window", sql("spans", """
    SELECT symbol, name FROM spans, (VALUES ('dot_com', TIMESTAMP '2000-03-10'), ('gfc', TIMESTAMP '2008-09-15'), ('covid', TIMESTAMP '2020-03-23'), ('rate_shock_2022', TIMESTAMP '2022-06-16')) AS e(name, d)
    WHERE d BETWEEN least(start, "end") AND greatest(start, "end")"""))
def _(spark, d):
    return universe.episodes_in(pit.asset_spans(base.prices(spark, d))).select("symbol", "name")


@query("a8_data_sufficiency", sql("cspans best_cut rhythm", f"""
    SELECT (SELECT count(*) FROM cspans) AS asset_count, {D.format('(SELECT min(start) FROM cspans)')} AS history_start, {D.format('(SELECT max("end") FROM cspans)')} AS history_end,
      n AS universe_size, {D.format('start')} AS overlap_start, {D.format('"end"')} AS overlap_end, {rd('months', 4)} AS overlap_months,
      {rd('(SELECT max(median_days) FROM rhythm WHERE symbol IN (SELECT unnest(members) FROM best_cut))', 4)} AS coarsest_days,
      (SELECT count(DISTINCT cadence) <= 1 FROM rhythm WHERE symbol IN (SELECT unnest(members) FROM best_cut)) AS homogeneous, 'ok' AS reason, TRUE AS sufficient FROM best_cut"""))
def _(spark, d):
    row = universe.sufficiency(customer_prices(spark, d), 2, 60.0)
    return row.select("asset_count", day("history_start").alias("history_start"), day("history_end").alias("history_end"), "universe_size",
                      day("overlap_start").alias("overlap_start"), day("overlap_end").alias("overlap_end"), r("overlap_months", 4).alias("overlap_months"),
                      r("coarsest_days", 4).alias("coarsest_days"), "homogeneous", "reason", "sufficient")


@query("b7_insufficient_data", sql("cspans", f"""
    SELECT 'insufficient_data' AS status, 'no_alpha_claim' AS claim_boundary, count(*) AS asset_count,
      CASE WHEN max(start) <= min("end") THEN 'history_below_min_window' ELSE 'no_cotemporal_overlap' END AS reason FROM cspans"""))
def _(spark, d):
    row = universe.sufficiency(customer_prices(spark, d), 2, 240.0)
    return reports.insufficient_data(row).select("status", "claim_boundary", "asset_count", "reason")


# -- runs, leaderboards, comparisons ------------------------------------------

_FOUR = backtest_blocks("wi_all", "index_legs", 45)


def four_runs(spark, d):
    """The four index strategies as run records."""
    return runs.records(index_weights(spark, d), base.index_prices(spark, d), CONFIG,
                        {"equal_weight": {}, "static": {}, "random": {"claim_boundary": "no_alpha_claim"}, "sma_timing": {"claim_boundary": "no_alpha_claim"}},
                        baselines=["equal_weight"])


@query("o1_leaderboard", sql("wi_all index_legs seg", f"""
    SELECT run AS run_id, {rd('sharpe')} AS oos_net_sharpe, run = 'equal_weight' AS is_baseline, row_number() OVER (ORDER BY sharpe DESC NULLS LAST, run) AS rank
    FROM metric WHERE segment = 'out_of_sample'""", **_FOUR))
def _(spark, d):
    return runs.leaderboard(four_runs(spark, d)).select(
        "run_id", r("oos_net_sharpe").alias("oos_net_sharpe"), "is_baseline", F.col("rank").cast("long").alias("rank"))


@query("f11_oos_net_metric", sql("wi_all index_legs seg", f"SELECT run AS run_id, {rd('sharpe')} AS sharpe, {rd('max_drawdown')} AS max_drawdown FROM metric WHERE segment = 'out_of_sample'", **_FOUR))
def _(spark, d):
    m = four_runs(spark, d).select("run_id", oos_net(F.col("metrics")).alias("m"))
    return m.select("run_id", r(F.col("m.sharpe")).alias("sharpe"), r(F.col("m.max_drawdown")).alias("max_drawdown"))


@query("j14_leaderboard_records", sql("wi_all index_legs seg", f"""
    SELECT run AS run_id, {rd('sharpe')} AS oos_net_sharpe, CASE WHEN run IN ('random', 'sma_timing') THEN 'no_alpha_claim' END AS claim, {rd('turnover')} AS turnover
    FROM metric WHERE segment = 'out_of_sample'""", **_FOUR))
def _(spark, d):
    records = four_runs(spark, d)
    return runs.leaderboard_records(records).select("run_id", r("oos_net_sharpe").alias("oos_net_sharpe"),
                                                    F.col("strategy_metadata")["claim_boundary"].alias("claim"),
                                                    r(oos_net(F.col("metrics"))["turnover"]).alias("turnover"))


@query("a17_family_evaluation", sql("wi_all index_legs seg", f"""
    SELECT 'no_alpha_claim' AS claim_boundary, string_agg(DISTINCT family, ',' ORDER BY family) AS families, string_agg(run, ',' ORDER BY run) FILTER (WHERE run = 'equal_weight') AS baseline_run_ids,
      count(*) AS scores, {rd('max(sharpe)')} AS best FROM metric JOIN (VALUES ('naive', 'equal_weight'), ('naive', 'static'), ('naive', 'random'), ('timing', 'sma_timing')) AS f(family, run) USING (run)
    WHERE segment = 'out_of_sample'""", **_FOUR))
def _(spark, d):
    families = spark.createDataFrame([("naive", ["equal_weight", "static", "random"]), ("timing", ["sma_timing"])], "model_family string, run_ids array<string>")
    scores = runs.family_scores(four_runs(spark, d), families)
    return runs.family_evaluation(scores).select(
        "claim_boundary", F.array_join("families", ",").alias("families"), F.array_join("baseline_run_ids", ",").alias("baseline_run_ids"),
        "scores", r("best").alias("best"))


@query("o2_ranked_rows", sql("wi_all index_legs seg", f"""
    SELECT run AS strategy_name, {rd('sharpe')} AS oos_net_sharpe, run = 'equal_weight' AS is_baseline, row_number() OVER (ORDER BY sharpe DESC, run) AS rank
    FROM metric WHERE segment = 'out_of_sample'""", **_FOUR))
def _(spark, d):
    rows = runs.ranked_rows(four_runs(spark, d))
    return rows.select("strategy_name", r("oos_net_sharpe").alias("oos_net_sharpe"), "is_baseline", F.col("rank").cast("long").alias("rank"))


@query("b2_run_and_log", sql("wi_all index_legs seg", f"""
    SELECT run AS run_id, count(*) AS segments, {rd("max(sharpe) FILTER (WHERE segment = 'out_of_sample')")} AS oos_net_sharpe FROM metric GROUP BY run""", **_FOUR))
def _(spark, d):
    stored = runs.run_and_log(spark, four_runs(spark, d))
    return stored.select("run_id", F.size("metrics").cast("long").alias("segments"), r("oos_net_sharpe").alias("oos_net_sharpe"))


cte("w_slice", """SELECT 'hedge' AS run, k, symbol, weight FROM (
      SELECT c.k, '3-MEDIUM' AS symbol, CASE WHEN n > 0 THEN 0.7 ELSE 1.0 END AS weight FROM cal c LEFT JOIN (SELECT k, count(*) AS n FROM chosen GROUP BY k) USING (k)
      UNION ALL SELECT k, symbol, 0.3 / count(*) OVER (PARTITION BY k) FROM chosen)
    UNION ALL SELECT 'buy_and_hold', k, '3-MEDIUM', 1.0 FROM cal
    UNION ALL SELECT * FROM wi_equal UNION ALL SELECT * FROM wi_random""", ["cal", "chosen", "wi_equal", "wi_random"])


@query("b3_hedge_slice", sql("w_slice index_legs seg", f"""
    SELECT run AS run_id, {rd('sharpe')} AS oos_net_sharpe, row_number() OVER (ORDER BY sharpe DESC, run) AS rank FROM metric WHERE segment = 'out_of_sample'""",
    **backtest_blocks("w_slice", "index_legs", 45)))
def _(spark, d):
    board = benchmarks.hedge_slice(base.index_prices(spark, d), CONFIG, target="3-MEDIUM", hedge_fraction=0.3, seed=7)
    return board.select("run_id", r("oos_net_sharpe").alias("oos_net_sharpe"), F.col("rank").cast("long").alias("rank"))


# the regime benchmark has its own calendar: dates due or changed
cte("rcal", "SELECT CAST(row_number() OVER (ORDER BY as_of) - 1 AS INTEGER) AS k, as_of, label FROM due", ["due"])
cte("rlegs", """SELECT a.k, a.symbol, b.close / a.close - 1 AS leg FROM (SELECT c.k, i.symbol, i.close FROM rcal c JOIN index_asof i USING (as_of)) a
    JOIN (SELECT c.k, i.symbol, i.close FROM rcal c JOIN index_asof i USING (as_of)) b ON a.symbol = b.symbol AND b.k = a.k + 1""", ["rcal", "index_asof"])
cte("w_regime", """SELECT 'regime' AS run, k, symbol, weight FROM rcal JOIN books USING (label)
    UNION ALL SELECT 'baseline', k, symbol, 0.5 FROM rcal, (VALUES ('1-URGENT'), ('5-LOW')) AS t(symbol)""", ["rcal", "books"])
_RB = backtest_blocks("w_regime", "rlegs", 5, "rcal")


@query("b4_regime_benchmark", sql("w_regime rlegs rcal", f"""
    SELECT run AS run_id, segment, {METRIC_SQL} FROM metric""",
    rwalk="SELECT 0 AS fold, min(as_of) AS start FROM rcal UNION ALL SELECT fold + 1, start + INTERVAL 6 MONTH FROM rwalk WHERE fold < 100",
    rfolds="SELECT fold, start, start + INTERVAL 6 MONTH AS split, start + INTERVAL 6 MONTH + INTERVAL 6 MONTH AS stop FROM rwalk WHERE start + INTERVAL 6 MONTH <= (SELECT max(as_of) FROM rcal)",
    seg="SELECT 'full' AS segment, k FROM rcal UNION SELECT 'in_sample', k FROM rcal JOIN rfolds ON as_of >= start AND as_of < split UNION SELECT 'out_of_sample', k FROM rcal JOIN rfolds ON as_of >= split AND as_of < stop",
    **_RB))
def _(spark, d):
    m = benchmarks.regime_benchmark(base.index_prices(spark, d), base.macro(spark, d), MONTHLY, risk_symbol="1-URGENT", defensive_symbol="5-LOW",
                                    curve_series="SPREAD", lookback=6, books={"risk_on": RISK_ON, "defensive": DEFENSIVE, "unknown": UNKNOWN})
    return metric_output(m.withColumnRenamed("run", "run_id"), "run_id", "segment")


def against_equal(run: str) -> str:
    cte(f"{run}_pair", f"SELECT * FROM {run} UNION ALL SELECT 'baseline', k, symbol, weight FROM wi_equal", [run, "wi_equal"])
    return sql(f"{run}_pair index_legs seg", f"""
        SELECT run AS run_id, {rd('sharpe')} AS oos_net_sharpe, run = 'baseline' AS is_baseline, row_number() OVER (ORDER BY sharpe DESC, run) AS rank
        FROM metric WHERE segment = 'out_of_sample'""", **backtest_blocks(f"{run}_pair", "index_legs", 5))


def _board(found):
    return found.select("run_id", r("oos_net_sharpe").alias("oos_net_sharpe"), "is_baseline", F.col("rank").cast("long").alias("rank"))


@query("b5_return_risk_benchmark", against_equal("forecast_allocation"))
def _(spark, d):
    return _board(benchmarks.return_risk_benchmark(base.index_prices(spark, d), CONFIG, base.ASSETS))


@query("b5_robust_benchmark", against_equal("robust_allocation"))
def _(spark, d):
    return _board(benchmarks.robust_benchmark(base.index_prices(spark, d), CONFIG, base.ASSETS))


cte("wi_two", "SELECT * FROM wi_equal UNION ALL SELECT * FROM wi_sma", ["wi_equal", "wi_sma"])


@query("b6_two_strategy_report", sql("wi_two index_legs seg", f"""
    SELECT 'computed' AS status, run AS strategy_name, {rd('sharpe')} AS oos_net_sharpe, run = 'equal_weight' AS is_baseline, row_number() OVER (ORDER BY sharpe DESC, run) AS rank
    FROM metric WHERE segment = 'out_of_sample'""", **backtest_blocks("wi_two", "index_legs", 45)))
def _(spark, d):
    table = index_weights(spark, d).filter(F.col("run").isin("equal_weight", "sma_timing"))
    report = reports.oos_report(base.index_prices(spark, d), table, CONFIG, baselines=["equal_weight"])
    return report.select("status", "strategy_name", r("oos_net_sharpe").alias("oos_net_sharpe"), "is_baseline", F.col("rank").cast("long").alias("rank"))


@query("b8_multi_family_report", sql("wi_all index_legs seg index_prices", f"""
    SELECT 'computed' AS status, CASE run WHEN 'equal_weight' THEN 'baseline' WHEN 'sma_timing' THEN 'timing' ELSE 'naive' END AS model_family, run AS strategy_name,
      {rd('sharpe')} AS oos_net_sharpe, run = 'equal_weight' AS is_baseline, row_number() OVER (ORDER BY sharpe DESC, run) AS rank, 'dot_com' AS episodes
    FROM metric WHERE segment = 'out_of_sample'""", **_FOUR))
def _(spark, d):
    families = {"equal_weight": "baseline", "static": "naive", "random": "naive", "sma_timing": "timing"}
    report = reports.oos_report(base.index_prices(spark, d), index_weights(spark, d), CONFIG, baselines=["equal_weight"], families=families)
    return report.select("status", "model_family", "strategy_name", r("oos_net_sharpe").alias("oos_net_sharpe"), "is_baseline",
                         F.col("rank").cast("long").alias("rank"), F.array_join("episodes", ",").alias("episodes"))


# One asset ends early and one begins late, so no window of two years is shared by all five.
def ragged_prices(spark, d):
    px = base.index_prices(spark, d)
    return px.filter(((F.col("symbol") != "4-NOT SPECIFIED") | (F.col("event_date") < F.lit("1997-01-01").cast("timestamp_ntz")))
                     & ((F.col("symbol") != "2-HIGH") | (F.col("event_date") >= F.lit("1998-01-01").cast("timestamp_ntz"))))


cte("ragged", """SELECT * FROM index_prices WHERE (symbol <> '4-NOT SPECIFIED' OR event_date < TIMESTAMP '1997-01-01') AND (symbol <> '2-HIGH' OR event_date >= TIMESTAMP '1998-01-01')""",
    ["index_prices"])
cte("ragged_spans", """SELECT symbol, min(event_date) AS first_date, max(event_date) AS last_date, row_number() OVER (ORDER BY symbol) - 1 AS bit FROM ragged GROUP BY symbol""", ["ragged"])
cte("ragged_best", """SELECT mask, max(first_date) AS lo, min(last_date) AS hi, count(*) AS size, date_diff('day', max(first_date), min(last_date)) / 30.4375 AS months
    FROM range(1, 32) AS m(mask) JOIN ragged_spans ON (mask >> bit::INTEGER) & 1 = 1 GROUP BY mask HAVING count(*) >= 2 AND months >= 24
    QUALIFY row_number() OVER (ORDER BY count(*) DESC, months DESC, list(symbol ORDER BY symbol) DESC) = 1""", ["ragged_spans"])
cte("ragged_universe", "SELECT symbol, first_date, last_date FROM ragged_spans, ragged_best WHERE (mask >> bit::INTEGER) & 1 = 1", ["ragged_spans", "ragged_best"])
cte("fcal", """SELECT CAST(row_number() OVER (ORDER BY d) - 1 AS INTEGER) AS k, CAST(d AS TIMESTAMP) AS as_of FROM (
      SELECT last_day(CAST(unnest(generate_series(date_trunc('month', lo), hi, INTERVAL 1 MONTH)) AS DATE)) AS d, lo, hi FROM ragged_best) WHERE d BETWEEN lo AND hi""", ["ragged_best"])
cte("fasof", """SELECT k, as_of, symbol, close FROM (SELECT c.k, c.as_of, p.*, row_number() OVER (PARTITION BY c.k, p.symbol ORDER BY available_date DESC, event_date DESC, close DESC) AS rn
      FROM fcal c JOIN ragged p ON p.available_date <= c.as_of SEMI JOIN ragged_universe u ON u.symbol = p.symbol) WHERE rn = 1""", ["fcal", "ragged", "ragged_universe"])
cte("flegs", "SELECT a.k, a.symbol, b.close / a.close - 1 AS leg FROM fasof a JOIN fasof b ON a.symbol = b.symbol AND b.k = a.k + 1 WHERE a.close > 0 AND b.close > 0", ["fasof"])
cte("fhist", """SELECT k, symbol, event_date, close FROM (SELECT c.k, p.symbol, p.event_date, p.close, row_number() OVER (PARTITION BY c.k, p.symbol, p.event_date ORDER BY available_date DESC, close DESC) AS rn
      FROM fcal c JOIN ragged p ON p.available_date <= c.as_of SEMI JOIN ragged_universe u ON u.symbol = p.symbol) WHERE rn = 1""", ["fcal", "ragged", "ragged_universe"])
cte("w_families", """SELECT 'baseline' AS run, k, symbol, 1.0 / (SELECT count(*) FROM ragged_universe) AS weight FROM fcal, ragged_universe
    UNION ALL SELECT 'timing', c.k, s.symbol, CASE WHEN n IS NULL THEN 0.0 WHEN n < 6 THEN 1.0 WHEN last > mean THEN 1.0 ELSE 0.0 END / (SELECT count(*) FROM ragged_universe)
      FROM fcal c CROSS JOIN ragged_universe s LEFT JOIN (SELECT k, symbol, count(*) AS n, avg(close) AS mean, arg_max(close, event_date) AS last FROM (
        SELECT *, row_number() OVER (PARTITION BY k, symbol ORDER BY event_date DESC) AS rn FROM fhist) WHERE rn <= 6 GROUP BY k, symbol) h ON h.k = c.k AND h.symbol = s.symbol
    UNION ALL SELECT 'trend', k, symbol, CASE WHEN total > 0 THEN w / total ELSE 1.0 / count(*) OVER (PARTITION BY k) END FROM (SELECT *, sum(w) OVER (PARTITION BY k) AS total FROM (
      SELECT k, symbol, CASE WHEN n = 7 THEN greatest(arg / old - 1, 0) ELSE 0 END AS w FROM (SELECT c.k, s.symbol, n, arg, old FROM fcal c CROSS JOIN ragged_universe s LEFT JOIN (
        SELECT k, symbol, count(*) AS n, arg_max(close, event_date) AS arg, arg_min(close, event_date) AS old FROM (
          SELECT *, row_number() OVER (PARTITION BY k, symbol ORDER BY event_date DESC) AS rn FROM fhist) WHERE rn <= 7 GROUP BY k, symbol) h ON h.k = c.k AND h.symbol = s.symbol)))""",
    ["fcal", "ragged_universe", "fhist"])
_FAMILIES = {
    "fwalk": "SELECT 0 AS fold, min(as_of) AS start FROM fcal UNION ALL SELECT fold + 1, start + INTERVAL 6 MONTH FROM fwalk WHERE fold < 100",
    "ffolds": "SELECT fold, start, start + INTERVAL 24 MONTH AS split, start + INTERVAL 24 MONTH + INTERVAL 6 MONTH AS stop FROM fwalk WHERE start + INTERVAL 24 MONTH <= (SELECT max(as_of) FROM fcal)",
    "seg": "SELECT 'full' AS segment, k FROM fcal UNION SELECT 'in_sample', k FROM fcal JOIN ffolds ON as_of >= start AND as_of < split UNION SELECT 'out_of_sample', k FROM fcal JOIN ffolds ON as_of >= split AND as_of < stop",
    **backtest_blocks("w_families", "flegs", 10, "fcal")}


def equal(prices, universe, calendar):
    return weights.equal_weight(universe, calendar)


def timing(prices, universe, calendar):
    return weights.sma_timing(prices, universe, calendar, window=6)


def trending(prices, universe, calendar):
    grid = universe.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(calendar) - 1))))
    rows = grid.join(weights.trend(prices, calendar, 6), ["k", "symbol"], "left").select("k", "symbol", F.coalesce("trend", F.lit(0.0)).alias("weight"))
    return weights.normalise(rows, ["k"])


def _families(spark, d, families):
    return reports.family_report(ragged_prices(spark, d), equal, families, costs=Costs(commission_bps=10), walk_forward=WalkForward(24, 6, 6), min_months=24.0)


def _family_rows(report):
    return report.rows.select("status", "model_family", r("oos_net_sharpe").alias("oos_net_sharpe"), "is_baseline", F.col("rank").cast("long").alias("rank"),
                              day("window_start").alias("window_start"), day("window_end").alias("window_end"))


_FAMILY_ROWS = f"""SELECT 'computed' AS status, run AS model_family, {rd('sharpe')} AS oos_net_sharpe, run = 'baseline' AS is_baseline,
      row_number() OVER (ORDER BY sharpe DESC, run) AS rank, {D.format('lo')} AS window_start, {D.format('hi')} AS window_end FROM metric, ragged_best WHERE segment = 'out_of_sample'"""


@query("b6_shared_universe_report", sql("w_families flegs ragged_best", _FAMILY_ROWS + " AND run IN ('baseline', 'timing')", **_FAMILIES))
def _(spark, d):
    return _family_rows(_families(spark, d, {"timing": timing}))


@query("b8_shared_universe_report", sql("w_families flegs ragged_best", _FAMILY_ROWS, **_FAMILIES))
def _(spark, d):
    return _family_rows(_families(spark, d, {"timing": timing, "trend": trending}))


@query("b8_provenance", sql("ragged ragged_best ragged_spans", f"""
    SELECT 'approximate_event_date' AS availability_mode, CAST(5 AS BIGINT) AS asset_count, size AS universe_size,
      {rd("date_diff('day', (SELECT min(event_date) FROM ragged), (SELECT max(event_date) FROM ragged)) / 30.4375", 4)} AS history_months,
      {D.format('lo')} AS overlap_start, {D.format('hi')} AS overlap_end, {rd('months', 4)} AS overlap_months, 31.0::DOUBLE AS coarsest_days, 'monthly' AS coarsest_cadence, TRUE AS homogeneous,
      'monthly' AS rebalance, 30.4375::DOUBLE AS rebalance_days, 10.0::DOUBLE AS cost_bps,
      coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM (VALUES ('dot_com', DATE '2000-03-10'), ('gfc', DATE '2008-09-15'), ('covid', DATE '2020-03-23'), ('rate_shock_2022', DATE '2022-06-16')) AS e(name, happened)
        WHERE happened BETWEEN lo AND hi), '') AS cycles_covered FROM ragged_best"""))
def _(spark, d):
    facts = _families(spark, d, {"timing": timing}).provenance
    return facts.select("availability_mode", F.col("asset_count").cast("long").alias("asset_count"), F.col("universe_size").cast("long").alias("universe_size"),
                        r("history_months", 4).alias("history_months"), day("overlap_start").alias("overlap_start"), day("overlap_end").alias("overlap_end"),
                        r("overlap_months", 4).alias("overlap_months"), "coarsest_days", "coarsest_cadence", "homogeneous", "rebalance", "rebalance_days", "cost_bps",
                        F.array_join("cycles_covered", ",").alias("cycles_covered"))


@query("b8_universe", sql("ragged ragged_universe", f"""
    SELECT symbol, {D.format('first_date')} AS first_date, {D.format('last_date')} AS last_date, median(gap)::DOUBLE AS median_days,
      CASE WHEN median(gap) <= 0 THEN 'irregular' WHEN median(gap) <= 4 THEN 'daily' WHEN median(gap) <= 10 THEN 'weekly' WHEN median(gap) <= 45 THEN 'monthly' WHEN median(gap) <= 135 THEN 'quarterly' ELSE 'irregular' END AS cadence
    FROM ragged_universe JOIN (SELECT symbol, date_diff('day', lag(event_date) OVER (PARTITION BY symbol ORDER BY event_date), event_date) AS gap FROM (SELECT DISTINCT symbol, event_date FROM ragged)) USING (symbol)
    GROUP BY symbol, first_date, last_date"""))
def _(spark, d):
    members = _families(spark, d, {"timing": timing}).universe
    return members.select("symbol", day("start").alias("first_date"), day("end").alias("last_date"), "median_days", "cadence")


@query("b10_performance_report", sql("series", f"""
    SELECT run, {rd('CASE WHEN s > 1e-12 THEN m / s * sqrt(12.0) ELSE 0 END')} AS oos_net_sharpe, n AS observations, {rd('eq')} AS final_equity, {rd('dd')} AS max_drawdown
    FROM (SELECT run, avg(ret) AS m, stddev_pop(ret) AS s, count(*) AS n FROM series GROUP BY run) JOIN (SELECT run, arg_max(equity, k) AS eq, min(drawdown) AS dd FROM equity GROUP BY run) USING (run)""",
    equity=base._CTE["equity"]))
def _(spark, d):
    from .returns import series
    report = reports.performance_report(series(spark, d), 12, 12)
    return report.select("run", r("oos_net_sharpe").alias("oos_net_sharpe"), "observations",
                         r(F.element_at("equity_curve", -1)).alias("final_equity"), r(F.array_min("drawdown")).alias("max_drawdown"))


@query("b12_run_summary", sql("wi_all index_legs seg", f"""
    SELECT run AS active_run_id, 'unknown' AS label, {rd('sharpe')} AS sharpe, row_number() OVER (ORDER BY sharpe DESC NULLS LAST, run) AS rank, 'no_alpha_claim' AS claim_boundary,
      'missing_regime_metadata' AS warnings, count(*) OVER () AS leaderboard_rows, run || '-x' AS experiments
    FROM metric WHERE segment = 'out_of_sample'""", **_FOUR))
def _(spark, d):
    runs = four_runs(spark, d)
    tried = runs.select(F.concat("run_id", F.lit("-x")).alias("experiment_id"), F.lit("f").alias("model_family"), F.array("run_id").alias("run_ids"))
    summary = reports.run_summary(runs, experiments=tried)
    rows = reports.summary_board(runs).agg(F.count("*").alias("n")).scalar()
    return summary.select("active_run_id", F.col("regime.label").alias("label"), r(F.col("oos_net_metrics.sharpe")).alias("sharpe"),
                          F.col("rank").cast("long").alias("rank"), "claim_boundary", F.array_join("warnings", ",").alias("warnings"),
                          rows.alias("leaderboard_rows"), F.col("experiments")[0]["experiment_id"].alias("experiments"))
