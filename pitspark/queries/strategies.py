"""Weight producers, estimates, allocation and the cointegration screen."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allocation, asof, calendars, moments, screen, weights
from ..session import local_table, materialise
from . import base
from .base import ASSETS, D, MONTHLY, cte, day, query, r, rd, sql
from .returns import STATIC, index_weights

RISK_ON = {"1-URGENT": 0.8, "5-LOW": 0.2}
DEFENSIVE = {"1-URGENT": 0.3, "5-LOW": 0.7}
UNKNOWN = {"1-URGENT": 0.5, "5-LOW": 0.5}


def _weights(frame):
    return frame.select("run", F.col("k").cast("long").alias("k"), "symbol", r("weight", 9).alias("weight"))


_W = f"SELECT run, CAST(k AS BIGINT) AS k, symbol, {rd('weight', 9)} AS weight FROM "


@query("m1_equal_weight", sql("w_equal", _W + "w_equal"))
def _(spark, d):
    return _weights(weights.equal_weight(base.suppliers(spark, d), MONTHLY))


@query("m2_static_weights", sql("wi_static", _W + "wi_static"))
def _(spark, d):
    known = base.index_prices(spark, d).select("symbol").distinct()
    table = known.join(local_table(spark, STATIC, "symbol string, weight double"), "symbol")
    return _weights(weights.static_weights(table, MONTHLY))


@query("m3_random_weights", sql("w_random", _W + "w_random"))
def _(spark, d):
    return _weights(weights.random_weights(base.suppliers(spark, d), MONTHLY, 7))


cte("sma", """SELECT c.k, s.symbol, n, mean, last FROM cal c CROSS JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier) s LEFT JOIN (
      SELECT k, symbol, count(*) AS n, avg(close) AS mean, arg_max(close, event_date) AS last FROM (
        SELECT *, row_number() OVER (PARTITION BY k, symbol ORDER BY event_date DESC) AS rn FROM hist) WHERE rn <= 10 GROUP BY k, symbol) h
    ON h.k = c.k AND h.symbol = s.symbol""", ["cal", "hist"])


@query("m4_sma_timing", sql("sma", f"""
    SELECT 'sma_timing' AS run, CAST(k AS BIGINT) AS k, symbol, CASE WHEN n IS NULL THEN 0.0 WHEN n < 10 THEN 1.0 WHEN last > mean THEN 1.0 ELSE 0.0 END + 0.0 AS weight FROM sma"""))
def _(spark, d):
    px = base.prices(spark, d)
    return _weights(weights.sma_timing(px, base.suppliers(spark, d), MONTHLY, 10))


@query("w5_sma_signal", sql("sma", f"""
    SELECT CAST(k AS BIGINT) AS k, symbol, n, {rd('mean')} AS mean, {rd('last')} AS last FROM sma WHERE n IS NOT NULL"""))
def _(spark, d):
    recent = asof.history_asof(base.prices(spark, d), MONTHLY, last=10)
    return recent.groupBy(F.col("k").cast("long").alias("k"), "symbol").agg(
        F.count("*").alias("n"), r(F.avg("close")).alias("mean"), r(F.max_by("close", "event_date")).alias("last"))


cte("trend", """SELECT k, symbol, CASE WHEN count(*) = 13 AND arg_min(close, event_date) > 0 THEN arg_max(close, event_date) / arg_min(close, event_date) - 1 END AS trend
    FROM (SELECT *, row_number() OVER (PARTITION BY k, symbol ORDER BY event_date DESC) AS rn FROM hist) WHERE rn <= 13 GROUP BY k, symbol""", ["hist"])


@query("w6_trailing_trend", sql("trend", f"SELECT CAST(k AS BIGINT) AS k, symbol, {rd('trend')} AS trend FROM trend"))
def _(spark, d):
    return weights.trend(base.prices(spark, d), MONTHLY, 12).select(F.col("k").cast("long").alias("k"), "symbol", r("trend").alias("trend"))


cte("itrend", """SELECT k, CASE WHEN count(*) = 7 AND arg_min(close, event_date) > 0 THEN arg_max(close, event_date) / arg_min(close, event_date) - 1 END AS trend
    FROM (SELECT *, row_number() OVER (PARTITION BY k, symbol ORDER BY event_date DESC) AS rn FROM index_hist WHERE symbol = '1-URGENT') WHERE rn <= 7 GROUP BY k""", ["index_hist"])
cte("regimes", """SELECT c.k, c.as_of, trend, curve,
      CASE WHEN trend IS NULL AND curve IS NULL THEN 'unknown' WHEN curve < 0 THEN 'defensive' WHEN trend < 0 THEN 'defensive' ELSE 'risk_on' END AS label,
      CASE WHEN trend IS NULL AND curve IS NULL THEN 0.0 WHEN curve < 0 THEN 0.75 WHEN trend < 0 THEN 0.65 ELSE 0.60 END AS confidence
    FROM cal c LEFT JOIN itrend USING (k) LEFT JOIN (SELECT k, value AS curve FROM macro_asof WHERE series = 'SPREAD') USING (k)""",
    ["cal", "itrend", "macro_asof"])


def regimes(spark, d):
    return weights.regime_labels(base.index_prices(spark, d), base.macro(spark, d), MONTHLY, "1-URGENT", "SPREAD", 6)


@query("f10_regime_labels", sql("regimes", f"""
    SELECT {D.format('as_of')} AS as_of, {rd('trend')} AS trend, {rd('curve', 4)} AS curve, label, {rd('confidence')} AS confidence FROM regimes"""))
def _(spark, d):
    return regimes(spark, d).select(day("as_of").alias("as_of"), r("trend").alias("trend"), r("curve", 4).alias("curve"), "label", r("confidence").alias("confidence"))


cte("due", """SELECT k, as_of, label FROM (SELECT *, row_number() OVER (ORDER BY as_of) AS rn, lag(label) OVER (ORDER BY as_of) AS b FROM regimes)
    WHERE rn = 1 OR rn % 3 = 0 OR label <> b""", ["regimes"])


@query("w7_change_triggered_dates", sql("due", f"SELECT {D.format('as_of')} AS as_of, label FROM due"))
def _(spark, d):
    return calendars.on_change_or_due(regimes(spark, d), "quarterly").select(day("as_of").alias("as_of"), "label")


@query("j9_label_lookup", sql("regimes", f"SELECT {D.format('as_of')} AS as_of, label FROM regimes WHERE month(as_of) % 3 = 0"))
def _(spark, d):
    labels = regimes(spark, d).select("as_of", "label")
    return calendars.require_labels(base.QUARTERLY.frame(spark).select("as_of"), labels).select(day("as_of").alias("as_of"), "label")


cte("books", """SELECT * FROM (VALUES ('risk_on', '1-URGENT', 0.8::DOUBLE), ('risk_on', '5-LOW', 0.2), ('defensive', '1-URGENT', 0.3), ('defensive', '5-LOW', 0.7),
    ('unknown', '1-URGENT', 0.5), ('unknown', '5-LOW', 0.5)) AS t(label, symbol, weight)""", [])


@query("m6_regime_allocation", sql("regimes books", f"SELECT 'regime' AS run, CAST(k AS BIGINT) AS k, symbol, {rd('weight', 9)} AS weight FROM regimes JOIN books USING (label)"))
def _(spark, d):
    return _weights(weights.regime_allocation(regimes(spark, d), {"risk_on": RISK_ON, "defensive": DEFENSIVE, "unknown": UNKNOWN}))


@query("p12_clip_and_normalise", sql("trend", f"""
    SELECT CAST(k AS BIGINT) AS k, symbol, {rd('CASE WHEN t > 0 THEN w / t ELSE 1.0 / n END', 9)} AS weight FROM (
      SELECT *, sum(w) OVER (PARTITION BY k) AS t, count(*) OVER (PARTITION BY k) AS n FROM (SELECT k, symbol, greatest(coalesce(trend, 0), 0) AS w FROM trend))"""))
def _(spark, d):
    raw = weights.trend(base.prices(spark, d), MONTHLY, 12).withColumnRenamed("trend", "weight")
    return weights.normalise(raw, ["k"]).select(F.col("k").cast("long").alias("k"), "symbol", r("weight", 9).alias("weight"))


# -- estimates ----------------------------------------------------------------

cte("own", """SELECT k, symbol, event_date, close / lag(close) OVER (PARTITION BY k, symbol ORDER BY event_date) - 1 AS ret FROM (
      SELECT *, row_number() OVER (PARTITION BY k, symbol ORDER BY event_date DESC) AS rn FROM hist) WHERE rn <= 37""", ["hist"])
cte("est", """SELECT c.k, s.symbol, coalesce(n, 0) AS n, coalesce(n >= 24, FALSE) AS ok, mean * 12 AS mean, vol * sqrt(12.0) AS vol, semid * sqrt(12.0) AS semidev
    FROM cal c CROSS JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier) s LEFT JOIN (
      SELECT k, symbol, count(*) AS n, avg(ret) AS mean, stddev_pop(ret) AS vol, sqrt(coalesce(avg(ret * ret) FILTER (WHERE ret < 0), 0)) AS semid
      FROM own WHERE ret IS NOT NULL GROUP BY k, symbol) e ON e.k = c.k AND e.symbol = s.symbol""", ["own", "cal", "prices"])


@query("a10_return_risk", sql("est", f"""
    SELECT CAST(k AS BIGINT) AS k, symbol, {rd('CASE WHEN ok THEN mean ELSE 0 END')} AS expected_return,
      {rd('CASE WHEN ok THEN greatest(vol, 1e-9) ELSE 0 END')} AS volatility, n AS observations, CASE WHEN ok THEN 'ok' ELSE 'degraded' END AS status FROM est"""))
def _(spark, d):
    px = base.prices(spark, d)
    return moments.return_risk(px, base.suppliers(spark, d), MONTHLY).select(
        F.col("k").cast("long").alias("k"), "symbol", r("expected_return").alias("expected_return"), r("volatility").alias("volatility"),
        F.col("observations").cast("long").alias("observations"), "status")


@query("a11_downside_risk", sql("est", f"""
    SELECT CAST(k AS BIGINT) AS k, symbol, {rd('CASE WHEN ok THEN mean ELSE 0 END')} AS mean_return, {rd('CASE WHEN ok THEN semidev ELSE 0 END')} AS downside_semideviation,
      {rd('CASE WHEN ok THEN mean - semidev ELSE 0 END')} AS adjusted_return, {rd('CASE WHEN ok THEN greatest(vol, 1e-6) ELSE 0 END')} AS volatility, n AS observations FROM est"""))
def _(spark, d):
    px = base.prices(spark, d)
    return moments.downside_risk(px, base.suppliers(spark, d), MONTHLY).select(
        F.col("k").cast("long").alias("k"), "symbol", *[r(c).alias(c) for c in ("mean_return", "downside_semideviation", "adjusted_return", "volatility")],
        F.col("observations").cast("long").alias("observations"))


cte("complete", "SELECT k, event_date FROM index_hist GROUP BY k, event_date HAVING count(DISTINCT symbol) = 5", ["index_hist"])
cte("crets", """SELECT * FROM (SELECT k, symbol, event_date, row_number() OVER (PARTITION BY k, symbol ORDER BY event_date DESC) AS rn,
      close / lag(close) OVER (PARTITION BY k, symbol ORDER BY event_date) - 1 AS ret FROM index_hist SEMI JOIN complete USING (k, event_date))
    WHERE rn <= 36 AND ret IS NOT NULL""", ["complete"])
cte("enough", "SELECT k, count(DISTINCT event_date) AS n FROM crets GROUP BY k HAVING count(DISTINCT event_date) >= 24", ["crets"])
cte("mus", "SELECT k, symbol, avg(ret) * 12 AS mu FROM crets SEMI JOIN enough USING (k) GROUP BY k, symbol", ["enough"])
cte("covs", """SELECT a.k, a.symbol AS s1, b.symbol AS s2, covar_samp(a.ret, b.ret) * 12 AS cov FROM crets a JOIN crets b USING (k, event_date)
    SEMI JOIN enough USING (k) GROUP BY a.k, a.symbol, b.symbol""", ["enough"])


def index_history(spark, d):
    return asof.history_asof(base.index_prices(spark, d), MONTHLY)


@query("a9_covariance", sql("covs", f"SELECT CAST(k AS BIGINT) AS k, s1, s2, {rd('cov')} AS covariance FROM covs"))
def _(spark, d):
    rows = moments.moments(index_history(spark, d), ASSETS, MONTHLY)
    return moments.covariance_rows(rows, ASSETS).select(F.col("k").cast("long").alias("k"), "s1", "s2", r("covariance").alias("covariance"))


@query("a9_mean", sql("mus", f"SELECT CAST(k AS BIGINT) AS k, symbol, {rd('mu')} AS mu FROM mus"))
def _(spark, d):
    rows = moments.moments(index_history(spark, d), ASSETS, MONTHLY).filter("n > 0")
    names = F.array(*[F.lit(s) for s in ASSETS])
    return rows.select(F.col("k").cast("long").alias("k"), F.explode(F.arrays_zip(names.alias("symbol"), F.col("mu"))).alias("p")).select(
        "k", "p.symbol", r(F.col("p.mu")).alias("mu"))


@query("a9_all_suppliers", sql("hist qcal", f"""
    SELECT CAST(a.k AS BIGINT) AS k, a.symbol AS s1, b.symbol AS s2, {rd('covar_samp(a.ret, b.ret) * 12')} AS covariance
    FROM rets a JOIN rets b USING (k, event_date) GROUP BY a.k, a.symbol, b.symbol HAVING count(*) >= 24""",
    sound="SELECT q.k, symbol, event_date, close FROM hist JOIN qcal q USING (as_of) WHERE close > 0",
    every="SELECT k, event_date FROM sound GROUP BY k, event_date HAVING count(DISTINCT symbol) = (SELECT count(*) FROM supplier)",
    rets="""SELECT * FROM (SELECT k, symbol, event_date, row_number() OVER (PARTITION BY k, symbol ORDER BY event_date DESC) AS rn,
              close / lag(close) OVER (PARTITION BY k, symbol ORDER BY event_date) - 1 AS ret FROM sound SEMI JOIN every USING (k, event_date)) WHERE rn <= 36 AND ret IS NOT NULL"""))
def _(spark, d):
    history = asof.history_asof(base.prices(spark, d), base.QUARTERLY).filter(asof.usable(F.col("close")))
    _, covariances = moments.block_moments(history, base.suppliers(spark, d), [36])
    return covariances.select(F.col("k").cast("long").alias("k"), "s1", "s2", r("covariance").alias("covariance"))


# -- allocation ---------------------------------------------------------------

_CANDIDATES = allocation.candidates(ASSETS)
_CAND_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({c}, '{s}', {w!r}::DOUBLE)" for c, row in enumerate(_CANDIDATES) for s, w in zip(ASSETS, row) if w > 0) + ") AS t(c, symbol, w)"


@query("m7_candidate_search", sql("mus covs", f"""
    SELECT CAST(k AS BIGINT) AS k, CAST(c AS BIGINT) AS candidate, {rd('mu')} AS expected_return, {rd('v')} AS variance FROM ranked WHERE rn = 1""",
    cand=_CAND_SQL,
    cand_mu="SELECT k, c, sum(w * mu) AS mu FROM cand JOIN mus USING (symbol) GROUP BY k, c",
    cand_v="SELECT k, a.c, sum(a.w * b.w * cov) AS v FROM covs JOIN cand a ON a.symbol = s1 JOIN cand b ON b.symbol = s2 AND b.c = a.c GROUP BY k, a.c",
    ranked="""SELECT *, row_number() OVER (PARTITION BY k ORDER BY v <= 0.09 DESC, CASE WHEN v <= 0.09 THEN -mu ELSE v END, c) AS rn
              FROM cand_mu JOIN cand_v USING (k, c)"""))
def _(spark, d):
    rows = moments.moments(index_history(spark, d), ASSETS, MONTHLY)
    found = allocation.candidate_search(rows, ASSETS, _CANDIDATES, 0.30)
    return found.select(F.col("k").cast("long").alias("k"), F.col("candidate").cast("long").alias("candidate"),
                        r("expected_return").alias("expected_return"), r("variance").alias("variance"))


# The optimum by trying out every set of held symbols: on each, weights are a + t * b for a tilt t, from one linear
# system, with variance g + t^2 * (b . mu); of those within the cap and not negative the highest return is the optimum.
cte("hz", "SELECT * FROM (VALUES (0, 12, 0.20::DOUBLE, 0.25::DOUBLE), (1, 36, 0.30, 0.50), (2, 60, 0.35, 0.25)) AS t(h, lookback, cap, share)", [])
cte("hrets", """SELECT h, k, symbol, event_date, ret FROM hz JOIN (SELECT k, symbol, event_date, row_number() OVER (PARTITION BY k, symbol ORDER BY event_date DESC) AS rn,
      close / lag(close) OVER (PARTITION BY k, symbol ORDER BY event_date) - 1 AS ret FROM index_hist SEMI JOIN complete USING (k, event_date)) ON rn <= lookback
    WHERE ret IS NOT NULL""", ["hz", "complete"])
cte("hmus", """SELECT k, h, list(mu ORDER BY symbol) AS mu FROM (SELECT k, h, symbol, avg(ret) * 12 AS mu FROM hrets GROUP BY k, h, symbol HAVING count(*) >= 24)
    GROUP BY k, h""", ["hrets"])
cte("hcovs", """SELECT k, h, list(c ORDER BY s1) AS cov FROM (SELECT k, h, s1, list(c ORDER BY s2) AS c FROM (
      SELECT a.k, a.h, a.symbol AS s1, b.symbol AS s2, covar_samp(a.ret, b.ret) * 12 AS c FROM hrets a JOIN hrets b USING (k, h, event_date) GROUP BY a.k, a.h, a.symbol, b.symbol)
    GROUP BY k, h, s1) GROUP BY k, h""", ["hrets"])
cte("hproblems", "SELECT k, h, cap, mu, cov FROM hmus JOIN hcovs USING (k, h) JOIN hz USING (h)", ["hmus", "hcovs", "hz"])


def _optima(problems: str, name: str) -> dict[str, str]:
    """Blocks over ``problems`` (k, h, cap, mu, cov); the block ``name`` has the best weights (k, h, symbol, weight)."""
    names = ", ".join(f"'{a}'" for a in ASSETS)
    return {
        f"{name}_held": f"""SELECT *, list_concat(list_transform(held, lambda i: list_concat(list_transform(held, lambda j: cov[i][j]), [-1.0::DOUBLE, 0.0, mu[i]])),
              [list_concat(list_transform(held, lambda j: 1.0::DOUBLE), [0.0::DOUBLE, 1.0, 0.0])]) AS g, 0 AS step FROM {problems},
              (SELECT mask, list_filter(range(1, {len(ASSETS) + 1}), lambda i: (mask >> (i - 1)::INTEGER) & 1 = 1) AS held FROM range(1, {2 ** len(ASSETS)}) AS m(mask))""",
        f"{name}_solved": f"""SELECT k, h, cap, mu, cov, held, step, g FROM {name}_held
            UNION ALL SELECT k, h, cap, mu, cov, held, step + 1, list_transform(range(1, len(g) + 1), lambda i: list_transform(range(1, len(g) + 3), lambda j:
              CASE WHEN i = step + 1 THEN g[i][j] / g[i][i] ELSE g[i][j] - g[i][step + 1] * g[step + 1][j] / g[step + 1][step + 1] END)) FROM {name}_solved WHERE step < len(g)""",
        f"{name}_lines": f"""SELECT *, list_sum(list_transform(range(1, len(held) + 1), lambda i: b[i] * mu[held[i]])) AS bend FROM (
              SELECT k, h, cap, mu, cov, held, list_transform(g[:len(held)], lambda r: r[-2]) AS a, list_transform(g[:len(held)], lambda r: r[-1]) AS b, g[-1][-2] AS flat
              FROM {name}_solved WHERE step = len(g))""",
        f"{name}_tried": f"""SELECT k, h, held, list_sum(list_transform(range(1, len(held) + 1), lambda i: w[i] * mu[held[i]])) AS gain, flat, fits, w FROM (
              SELECT *, 0 AS fits, a AS w FROM {name}_lines
              UNION ALL SELECT *, 1, a FROM {name}_lines WHERE len(held) = 1 AND flat <= cap * cap
              UNION ALL SELECT *, 1, list_transform(range(1, len(held) + 1), lambda i: a[i] + sqrt(greatest(cap * cap - flat, 0) / bend) * b[i]) FROM {name}_lines
              WHERE len(held) > 1 AND bend > 1e-14 AND flat <= cap * cap) WHERE list_min(w) >= -1e-11""",
        f"{name}_best": f"SELECT * FROM {name}_tried QUALIFY row_number() OVER (PARTITION BY k, h ORDER BY fits DESC, CASE fits WHEN 1 THEN -gain ELSE flat END, len(held)) = 1",
        name: f"""SELECT k, h, ([{names}])[i] AS symbol, coalesce(w[list_position(held, i)], 0) AS weight FROM {name}_best, range(1, {len(ASSETS) + 1}) AS s(i)""",
    }


_EQUAL = f"{1.0 / len(ASSETS)!r}::DOUBLE"
_NAMES = "(SELECT DISTINCT symbol FROM index_prices)"


@query("m7_mean_variance", sql("cal index_prices hproblems", f"""
    SELECT 'mean_variance' AS run, CAST(c.k AS BIGINT) AS k, s.symbol, {rd(f'coalesce(weight, {_EQUAL})')} AS weight FROM cal c CROSS JOIN {_NAMES} s
    LEFT JOIN optimum o ON o.k = c.k AND o.symbol = s.symbol""", medium="SELECT * FROM hproblems WHERE h = 1", **_optima("medium", "optimum")))
def _(spark, d):
    found = allocation.mean_variance(index_history(spark, d), ASSETS, MONTHLY, 0.30)
    return found.select("run", F.col("k").cast("long").alias("k"), "symbol", r("weight").alias("weight"))


@query("m7_optimality", sql("cal hproblems", f"""
    SELECT CAST(k AS BIGINT) AS k, CASE WHEN fits = 0 THEN 'least_variance' WHEN len(held) = 1 THEN 'corner' ELSE 'cap' END AS regime, {rd('gain')} AS expected_return,
      {rd('CASE WHEN fits = 1 AND len(held) > 1 THEN 0.09 ELSE flat END')} AS variance, TRUE AS optimal FROM optimum_best""",
    medium="SELECT * FROM hproblems WHERE h = 1", **_optima("medium", "optimum")))
def _(spark, d):
    rows = moments.moments(index_history(spark, d), ASSETS, MONTHLY).filter("n > 0")
    solved = rows.select("k", "mu", "cov", allocation.optimum(F.col("mu"), F.col("cov"), F.lit(0.30), F.lit(1.0)).alias("o"))
    n = len(ASSETS)
    gain = F.aggregate(F.zip_with("mu", "o.w", lambda m, x: m * x), F.lit(0.0), lambda s, x: s + x)
    cells = F.transform(F.col("cov"), lambda c, i: c * F.get(F.col("o.w"), (i / n).cast("int")) * F.get(F.col("o.w"), i % n))
    return solved.select(F.col("k").cast("long").alias("k"), "o.regime", r(gain).alias("expected_return"),
                         r(F.aggregate(cells, F.lit(0.0), lambda s, x: s + x)).alias("variance"), (F.col("o.residual") < 1e-7).alias("optimal"))


@query("m7_optimum_dominates_candidates", sql("mus covs", f"""
    SELECT CAST(k AS BIGINT) AS k, {rd('mu')} AS candidate_return, v <= 0.09 AS reachable, TRUE AS not_worse, TRUE AS within_cap FROM ranked WHERE rn = 1""",
    cand=_CAND_SQL,
    cand_mu="SELECT k, c, sum(w * mu) AS mu FROM cand JOIN mus USING (symbol) GROUP BY k, c",
    cand_v="SELECT k, a.c, sum(a.w * b.w * cov) AS v FROM covs JOIN cand a ON a.symbol = s1 JOIN cand b ON b.symbol = s2 AND b.c = a.c GROUP BY k, a.c",
    ranked="""SELECT *, row_number() OVER (PARTITION BY k ORDER BY v <= 0.09 DESC, CASE WHEN v <= 0.09 THEN -mu ELSE v END, c) AS rn
              FROM cand_mu JOIN cand_v USING (k, c)"""))
def _(spark, d):
    # the solver's weights against the best of the candidate table, on each date's own moments
    rows = moments.moments(index_history(spark, d), ASSETS, MONTHLY).filter("n > 0")
    found = allocation.candidate_search(rows, ASSETS, _CANDIDATES, 0.30).select("k", "expected_return", "variance")
    solved = rows.withColumn("w", allocation.best_weights(F.col("mu"), F.col("cov"), F.lit(0.30), F.lit(1.0)))
    n = len(ASSETS)
    mean = F.aggregate(F.zip_with("mu", "w", lambda m, x: m * x), F.lit(0.0), lambda s, x: s + x)
    cells = F.transform(F.col("cov"), lambda c, i: c * F.get(F.col("w"), (i / n).cast("int")) * F.get(F.col("w"), i % n))
    variance = F.aggregate(cells, F.lit(0.0), lambda s, x: s + x)
    both = solved.select("k", mean.alias("mean"), variance.alias("v")).join(found, "k")
    reachable = F.col("variance") <= 0.09
    better = F.when(reachable, F.col("mean") >= F.col("expected_return") - 1e-7).otherwise(F.col("v") <= F.col("variance") + 1e-9)
    return both.select(F.col("k").cast("long").alias("k"), r("expected_return").alias("candidate_return"), reachable.alias("reachable"),
                       better.alias("not_worse"), (F.col("v") <= F.greatest(F.lit(0.09), F.col("variance")) + 1e-7).alias("within_cap"))


@query("m8_multi_horizon", sql("cal index_prices hz hproblems", f"""
    SELECT 'multi_horizon' AS run, CAST(c.k AS BIGINT) AS k, s.symbol, {rd(f'sum(share * coalesce(weight, {_EQUAL}))')} AS weight
    FROM cal c CROSS JOIN {_NAMES} s CROSS JOIN hz LEFT JOIN optimum o ON o.k = c.k AND o.symbol = s.symbol AND o.h = hz.h GROUP BY c.k, s.symbol""",
    **_optima("hproblems", "optimum")))
def _(spark, d):
    found = allocation.multi_horizon(index_history(spark, d), ASSETS, MONTHLY)
    return found.select("run", F.col("k").cast("long").alias("k"), "symbol", r("weight").alias("weight"))


# M9 and M10 by the same trial of every set, with covariances of nothing but own variances
cte("iest", """SELECT k, symbol, count(*) AS n, avg(ret) * 12 AS mean, stddev_pop(ret) * sqrt(12.0) AS vol, sqrt(coalesce(avg(ret * ret) FILTER (WHERE ret < 0), 0)) * sqrt(12.0) AS below
    FROM (SELECT k, symbol, close / lag(close) OVER (PARTITION BY k, symbol ORDER BY event_date) - 1 AS ret FROM (
      SELECT *, row_number() OVER (PARTITION BY k, symbol ORDER BY event_date DESC) AS rn FROM index_hist) WHERE rn <= 37) WHERE ret IS NOT NULL GROUP BY k, symbol""", ["index_hist"])


def _independent(name: str, mean: str, floor: str) -> None:
    cte(f"{name}_problems", f"""SELECT k, 0 AS h, 0.30::DOUBLE AS cap, mu, list_transform(range(1, len(mu) + 1), lambda i: list_transform(range(1, len(mu) + 1), lambda j:
          CASE WHEN i = j THEN vol[i] * vol[i] ELSE 0.0 END)) AS cov FROM (SELECT k, list({mean} ORDER BY symbol) AS mu, list(greatest(vol, {floor}) ORDER BY symbol) AS vol
        FROM iest GROUP BY k HAVING count(*) = {len(ASSETS)} AND min(n) >= 24)""", ["iest"])
    needs = f"{name}_problems"
    for block, text in _optima(f"{name}_problems", f"{name}_optimum").items():
        cte(block, text, [needs])
        needs = block
    cte(name, f"SELECT '{name}' AS run, c.k, s.symbol, coalesce(weight, {_EQUAL}) AS weight FROM cal c CROSS JOIN {_NAMES} s LEFT JOIN {name}_optimum o ON o.k = c.k AND o.symbol = s.symbol",
        ["cal", "index_prices", needs])


_independent("forecast_allocation", "mean", "1e-9")
_independent("robust_allocation", "mean - below", "1e-6")


@query("m9_forecast_allocation", sql("forecast_allocation", f"SELECT run, CAST(k AS BIGINT) AS k, symbol, {rd('weight')} AS weight FROM forecast_allocation"))
def _(spark, d):
    px = base.index_prices(spark, d)
    found = allocation.diagonal_allocation(moments.return_risk(px, base.assets(spark), MONTHLY), ASSETS)
    return found.select("run", F.col("k").cast("long").alias("k"), "symbol", r("weight").alias("weight"))


@query("m10_robust_allocation", sql("robust_allocation", f"SELECT run, CAST(k AS BIGINT) AS k, symbol, {rd('weight')} AS weight FROM robust_allocation"))
def _(spark, d):
    est = moments.downside_risk(base.index_prices(spark, d), base.assets(spark), MONTHLY)
    found = allocation.diagonal_allocation(est, ASSETS, mean="adjusted_return", run="robust_allocation")
    return found.select("run", F.col("k").cast("long").alias("k"), "symbol", r("weight").alias("weight"))


# -- screen -------------------------------------------------------------------

TARGET = "3-MEDIUM"
_Z = "CASE WHEN {0} > 2.74 THEN CAST('inf' AS DOUBLE) WHEN {0} < -18.83 THEN CAST('-inf' AS DOUBLE) WHEN {0} <= -1.61 THEN 2.1659 + {0} * (1.4412 + {0} * 0.038269) ELSE 1.7339 + {0} * (0.93202 + {0} * (-0.12745 + {0} * -0.010368)) END"
cte("pairs", f"""SELECT c.k, c.symbol, c.event_date, c.close AS y, t.close AS x FROM index_hist c JOIN index_hist t
    ON t.k = c.k AND t.event_date = c.event_date AND t.symbol = '{TARGET}' WHERE c.symbol <> '{TARGET}'""", ["index_hist"])
cte("fits", "SELECT k, symbol, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM pairs GROUP BY k, symbol", ["pairs"])
cte("resid", """SELECT k, symbol, any_value(n) AS n, any_value(slope) AS slope, list(y - slope * x - intercept ORDER BY event_date) AS e,
      least(any_value(n) // 2 - 2, CAST(ceil(12 * pow(any_value(n) / 100.0, 0.25)) AS BIGINT)) AS most
    FROM pairs JOIN fits USING (k, symbol) WHERE n >= 30 GROUP BY k, symbol""", ["pairs", "fits"])
cte("changes", "SELECT *, list_transform(range(1, n), lambda t: e[t + 1] - e[t]) AS d FROM resid", ["resid"])
_GRAM = "list_transform({0}, lambda a: list_transform({0}, lambda b: list_dot_product(a, b)))"
_LEFT = "list_transform(range(2, len(g) + 1), lambda i: list_transform(range(2, len(g) + 1), lambda j: g[i][j] - g[i][1] * g[1][j] / g[1][1]))"
# after eliminating s columns the corner is the residual sum of squares with s - 2 lags
cte("wide", f"""SELECT k, symbol, n, most, 0 AS s, {_GRAM.format('x')} AS g FROM (SELECT *, list_concat(
      [list_transform(range(most, n - 1), lambda t: 1.0::DOUBLE), e[most + 1:n - 1]], list_transform(range(1, most + 1), lambda j: d[most + 1 - j:n - 1 - j]), [d[most + 1:n - 1]]) AS x FROM changes)
    UNION ALL SELECT k, symbol, n, most, s + 1, {_LEFT} FROM wide WHERE s < most + 2""", ["changes"])
cte("chosen_lag", """SELECT k, symbol, CAST(s - 2 AS INTEGER) AS lag FROM wide WHERE s >= 2
    QUALIFY row_number() OVER (PARTITION BY k, symbol ORDER BY (n - 1 - most) * ln(g[-1][-1] / (n - 1 - most)) + 2 * s, s) = 1""", ["wide"])
cte("narrow", f"""SELECT k, symbol, n, slope, lag, 0 AS s, {_GRAM.format('x')} AS g FROM (SELECT *, list_concat(
      [list_transform(range(lag, n - 1), lambda t: 1.0::DOUBLE)], list_transform(range(1, lag + 1), lambda j: d[lag + 1 - j:n - 1 - j]), [e[lag + 1:n - 1], d[lag + 1:n - 1]]) AS x
      FROM changes JOIN chosen_lag USING (k, symbol))
    UNION ALL SELECT k, symbol, n, slope, lag, s + 1, {_LEFT} FROM narrow WHERE s < lag + 1""", ["changes", "chosen_lag"])
cte("tested", f"""SELECT *, {_Z.format('t')} AS z FROM (SELECT k, symbol, n, slope, lag,
      g[1][2] / sqrt((g[2][2] - g[1][2] * g[1][2] / g[1][1]) / (n - 1 - lag - (lag + 2)) * g[1][1]) AS t FROM narrow WHERE s = lag + 1)""", ["narrow"])
# the normal distribution as in Abramowitz and Stegun 7.1.26
_TAIL = """(((((1.061405429 * u - 1.453152027) * u + 1.421413741) * u - 0.284496736) * u + 0.254829592) * u) * exp(-z * z / 2) / 2"""
cte("p_tested", f"""SELECT *, CASE WHEN z = 'inf'::DOUBLE THEN 1.0 WHEN z = '-inf'::DOUBLE THEN 0.0 WHEN z >= 0 THEN 1.0 - {_TAIL} ELSE {_TAIL} END AS p
    FROM (SELECT *, 1.0::DOUBLE / (1.0 + 0.3275911 * abs(z) / sqrt(2.0)) AS u FROM tested)""", ["tested"])


@query("a13_hedge_ratio", sql("fits", f"""
    SELECT CAST(k AS BIGINT) AS k, symbol, n, {rd('slope')} AS slope, {rd('intercept', 4)} AS intercept FROM fits"""))
def _(spark, d):
    return screen.hedge_ratio(index_history(spark, d), TARGET).select(
        F.col("k").cast("long").alias("k"), "symbol", "n", r("slope").alias("slope"), r("intercept", 4).alias("intercept"))


@query("a14_cointegration", sql("p_tested", f"""
    SELECT CAST(k AS BIGINT) AS k, symbol, n, {rd('slope')} AS hedge_ratio, lag, {rd('t')} AS t_stat, {rd('p')} AS p_value, z < -1.6448536269514726 AS cointegrated,
      slope < 0 AS reverse, z < -1.6448536269514726 AND slope < 0 AS selected FROM p_tested"""))
def _(spark, d):
    return screen.cointegration(index_history(spark, d), TARGET).filter("n >= 30").select(
        F.col("k").cast("long").alias("k"), "symbol", "n", r("hedge_ratio").alias("hedge_ratio"), "lag", r("t_stat").alias("t_stat"),
        r("p_value").alias("p_value"), "cointegrated", "reverse", "selected")


cte("chosen", "SELECT k, symbol, t FROM tested WHERE z < -1.6448536269514726 AND slope < 0", ["tested"])


@query("o3_screen_ranking", sql("chosen", f"""
    SELECT CAST(k AS BIGINT) AS k, symbol, {rd('t')} AS t_stat, row_number() OVER (PARTITION BY k ORDER BY t, symbol) AS rank FROM chosen"""))
def _(spark, d):
    return screen.ranking(screen.cointegration(index_history(spark, d), TARGET)).select(
        F.col("k").cast("long").alias("k"), "symbol", r("t_stat").alias("t_stat"), F.col("rank").cast("long").alias("rank"))


@query("m5_cointegration_hedge", sql("cal chosen", f"""
    SELECT 'hedge' AS run, CAST(k AS BIGINT) AS k, symbol, {rd('weight', 9)} AS weight FROM (
      SELECT c.k, '{TARGET}' AS symbol, CASE WHEN n > 0 THEN 0.7 ELSE 1.0 END AS weight FROM cal c LEFT JOIN (SELECT k, count(*) AS n FROM chosen GROUP BY k) USING (k)
      UNION ALL SELECT k, symbol, 0.3 / count(*) OVER (PARTITION BY k) FROM chosen)"""))
def _(spark, d):
    chosen = materialise(screen.cointegration(index_history(spark, d), TARGET).filter("selected"), "selected")
    return _weights(weights.hedge_weights(chosen, MONTHLY, TARGET, 0.3))


@query("f18_hedge_weights", sql("cal itrend index_hist", f"""
    SELECT CAST(k AS BIGINT) AS k, symbol, {rd('sum(weight)', 9)} AS weight FROM (
      SELECT c.k, '1-URGENT' AS symbol, CASE WHEN n > 0 THEN 0.6 ELSE 1.0 END AS weight FROM cal c LEFT JOIN (SELECT k, count(*) AS n FROM falling GROUP BY k) USING (k)
      UNION ALL SELECT k, symbol, 0.4 / count(*) OVER (PARTITION BY k) FROM falling) GROUP BY k, symbol""",
    falling="""SELECT k, symbol FROM (SELECT k, symbol, count(*) AS n, arg_max(close, event_date) / arg_min(close, event_date) - 1 AS trend FROM (
        SELECT *, row_number() OVER (PARTITION BY k, symbol ORDER BY event_date DESC) AS rn FROM index_hist) WHERE rn <= 7 GROUP BY k, symbol)
        WHERE n = 7 AND trend < 0"""))
def _(spark, d):
    falling = weights.trend(base.index_prices(spark, d), MONTHLY, 6).filter("trend < 0").select("k", "symbol")
    return weights.hedge_weights(falling, MONTHLY, "1-URGENT", 0.4).select(
        F.col("k").cast("long").alias("k"), "symbol", r("weight", 9).alias("weight"))


@query("x1_strategy_as_query", sql("wi_all", _W + "wi_all"))
def _(spark, d):
    return _weights(index_weights(spark, d))
