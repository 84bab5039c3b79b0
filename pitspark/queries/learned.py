"""Learned forecasts: feature windows, training, sweeps and realised series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, forecast, weights
from ..operators.backtest import realised_returns
from ..operators.forecast import Network
from ..plans import benchmarks, experiments
from ..session import scratch_path
from . import base
from .base import ASSETS, MONTHLY, cte, query, r, rd, sql
from .research import against_equal
from .returns import CONFIG, index_weights
from .strategies import index_history

NET = Network()
GRID = [NET, Network(lookback=3, hidden=3, seed=1)]

cte("irets", """SELECT * FROM (SELECT k, symbol, event_date, close / lag(close) OVER (PARTITION BY k, symbol ORDER BY event_date) - 1 AS ret FROM index_hist) WHERE ret IS NOT NULL""", ["index_hist"])


@query("w11_feature_windows", sql("hist", f"""
    SELECT CAST(k AS BIGINT) AS k, symbol, count(*) AS n, {rd('sum(y)')} AS targets, {rd('sum(x0)')} AS oldest, {rd('sum(x5)')} AS newest FROM (
      SELECT k, symbol, ret AS y, lag(ret, 6) OVER w AS x0, lag(ret, 1) OVER w AS x5, row_number() OVER w AS rn FROM (
        SELECT * FROM (SELECT k, symbol, event_date, close / lag(close) OVER (PARTITION BY k, symbol ORDER BY event_date) - 1 AS ret FROM hist) WHERE ret IS NOT NULL)
      WINDOW w AS (PARTITION BY k, symbol ORDER BY event_date)) WHERE rn > 6 GROUP BY k, symbol"""))
def _(spark, d):
    rows = forecast.windows(asof.history_asof(base.prices(spark, d), MONTHLY), 6)
    return rows.groupBy(F.col("k").cast("long").alias("k"), "symbol").agg(
        F.count("*").alias("n"), r(F.sum("y")).alias("targets"), r(F.sum(F.get("x", F.lit(0)))).alias("oldest"), r(F.sum(F.get("x", F.lit(5)))).alias("newest"))


# Training in SQL: a recursive table has a row per date and epoch with every weight as a column, and a step joins it to
# the date's standardised windows and sums their slopes.
SWEEP = [NET, Network(hidden=2, seed=3, epochs=20), Network(lookback=3, hidden=3, seed=1), Network(lookback=12, hidden=2, epochs=12, rate=0.05)]


def _training(net: Network, name: str) -> dict[str, str]:
    """Blocks of one network; ``name`` has (k, symbol, expected_return, status, loss)."""
    width, hidden = range(net.lookback), range(net.hidden)
    flat = net.start().tolist()
    inner = {(i, h): f"w{i * net.hidden + h}" for i in width for h in hidden}
    bias, outer = ([f"w{net.lookback * net.hidden + part * net.hidden + h}" for h in hidden] for part in (0, 1))
    shift, count = f"w{net.size - 1}", net.size
    layers = ", ".join(f"tanh({bias[h]} + " + " + ".join(f"x{i} * {inner[i, h]}" for i in width) + f") AS a{h}" for h in hidden)
    guess = f"{shift} + " + " + ".join(f"a{h} * {outer[h]}" for h in hidden)
    slope = {shift: "sum(miss)"}
    for h in hidden:
        back = f"miss * {outer[h]} * (1 - a{h} * a{h})"
        slope |= {outer[h]: f"sum(miss * a{h})", bias[h]: f"sum({back})"} | {inner[i, h]: f"sum({back} * x{i})" for i in width}
    moved = ", ".join(f"any_value(w{j}) - {net.rate!r} * 2 * {slope[f'w{j}']} / any_value(n) AS w{j}" for j in range(count))
    weights = ", ".join(f"w{j}" for j in range(count))
    return {
        f"{name}_rows": "SELECT * FROM (SELECT k, symbol, event_date, ret AS y, " + ", ".join(f"lag(ret, {net.lookback - i}) OVER w AS x{i}" for i in width)
            + f""", row_number() OVER w AS place FROM irets WINDOW w AS (PARTITION BY k, symbol ORDER BY event_date)) WHERE place > {net.lookback}""",
        f"{name}_scale": "SELECT k, count(*) AS n, avg(y) AS my, stddev_pop(y) AS sy, " + ", ".join(f"avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}" for i in width)
            + f" FROM {name}_rows GROUP BY k HAVING count(*) >= {net.min_obs} AND stddev_pop(y) > 1e-12",
        f"{name}_std": f"SELECT k, n, (y - my) / sy AS y, " + ", ".join(f"(x{i} - m{i}) / CASE WHEN s{i} > 1e-12 THEN s{i} ELSE 1 END AS x{i}" for i in width)
            + f" FROM {name}_rows JOIN {name}_scale USING (k)",
        f"{name}_fit": f"SELECT k, 0 AS epoch, 0.0::DOUBLE AS loss, " + ", ".join(f"{v!r}::DOUBLE AS w{j}" for j, v in enumerate(flat)) + f" FROM {name}_scale"
            + f" UNION ALL SELECT k, any_value(epoch) + 1, sum(miss * miss) / any_value(n), {moved} FROM (SELECT *, {guess} - y AS miss FROM (SELECT f.*, x.* EXCLUDE (k), {layers}"
            + f" FROM {name}_fit f JOIN {name}_std x ON f.k = x.k WHERE epoch < {net.epochs})) GROUP BY k",
        f"{name}_last": f"SELECT k, symbol, {', '.join(f'x{i + 1} AS x{i}' for i in range(net.lookback - 1))}{', ' if net.lookback > 1 else ''}y AS x{net.lookback - 1}"
            + f" FROM {name}_rows QUALIFY row_number() OVER (PARTITION BY k, symbol ORDER BY event_date DESC) = 1 AND count(*) OVER (PARTITION BY k) > 0",
        f"{name}_ask": f"SELECT k, symbol, my, sy, loss, {weights}, " + ", ".join(f"(x{i} - m{i}) / CASE WHEN s{i} > 1e-12 THEN s{i} ELSE 1 END AS x{i}" for i in width)
            + f" FROM {name}_last JOIN {name}_scale USING (k) JOIN {name}_fit USING (k) WHERE epoch = {net.epochs}"
            + f" QUALIFY count(*) OVER (PARTITION BY k) = {len(ASSETS)}",
        f"{name}_loss": f"SELECT k, loss FROM {name}_fit WHERE epoch = {net.epochs}",
        name: f"SELECT c.k, s.symbol, coalesce(value, 0) AS expected_return, CASE WHEN value IS NULL THEN 'degraded' ELSE 'ok' END AS status, l.loss"
            + f" FROM cal c CROSS JOIN (SELECT DISTINCT symbol FROM index_prices) s LEFT JOIN {name}_loss l ON l.k = c.k LEFT JOIN"
            + f" (SELECT k, symbol, ({guess}) * sy + my AS value FROM (SELECT *, {layers} FROM {name}_ask)) g ON g.k = c.k AND g.symbol = s.symbol",
    }


def _register(net: Network, name: str) -> None:
    needs = ["cal", "index_prices", "irets"]
    for block, text in _training(net, name).items():
        cte(block, text, needs)
        needs = ["cal", "index_prices", block]


_register(NET, "learned")
for _i, _net in enumerate(SWEEP):
    _register(_net, f"sweep{_i}")
cte("learned_forecast", """SELECT 'learned_forecast' AS run, k, symbol, CASE WHEN sound AND total > 0 THEN w / total ELSE 1.0 / count(*) OVER (PARTITION BY k) END AS weight FROM (
      SELECT *, bool_and(status = 'ok') OVER (PARTITION BY k) AS sound, greatest(expected_return, 0) AS w, sum(greatest(expected_return, 0)) OVER (PARTITION BY k) AS total FROM learned)""",
    ["learned"])


@query("x2_learned_forecast", sql("learned", f"SELECT CAST(k AS BIGINT) AS k, symbol, {rd('expected_return')} AS expected_return, status FROM learned"))
def _(spark, d):
    rows, _ = forecast.forecast(index_history(spark, d), ASSETS, MONTHLY, [NET])
    return rows.select(F.col("k").cast("long").alias("k"), "symbol", r("expected_return").alias("expected_return"), "status")


@query("x3_parameter_sweep", sql(" ".join(f"sweep{i}" for i in range(len(SWEEP))), " UNION ALL ".join(
    f"SELECT {i}::BIGINT AS net, CAST(k AS BIGINT) AS k, symbol, {rd('expected_return')} AS expected_return, {rd('loss')} AS loss, status FROM sweep{i}" for i in range(len(SWEEP)))))
def _(spark, d):
    rows, trace = forecast.forecast(index_history(spark, d), ASSETS, MONTHLY, SWEEP)
    last = trace.groupBy("net", "k").agg(F.max_by("loss", "epoch").alias("loss"))
    return rows.join(last, ["net", "k"], "left").select(
        F.col("net").cast("long").alias("net"), F.col("k").cast("long").alias("k"), "symbol", r("expected_return").alias("expected_return"), r("loss").alias("loss"), "status")


@query("m11_learned_allocation", sql("learned_forecast", f"SELECT run, CAST(k AS BIGINT) AS k, symbol, {rd('weight')} AS weight FROM learned_forecast"))
def _(spark, d):
    rows, _ = forecast.forecast(index_history(spark, d), ASSETS, MONTHLY, [NET])
    return weights.forecast_weights(rows).select("run", F.col("k").cast("long").alias("k"), "symbol", r("weight").alias("weight"))


@query("b5_learned_benchmark", against_equal("learned_forecast"))
def _(spark, d):
    px = base.index_prices(spark, d)
    rows, _ = forecast.forecast(asof.history_asof(px, MONTHLY), ASSETS, MONTHLY, [NET])
    board = benchmarks.learned_benchmark(weights.forecast_weights(rows), px, CONFIG, ASSETS)
    return board.select("run_id", r("oos_net_sharpe").alias("oos_net_sharpe"), "is_baseline", F.col("rank").cast("long").alias("rank"))


@query("b11_experiment")
def _(spark, d):
    out = experiments.run_experiment(base.index_prices(spark, d), ASSETS, GRID, registry=scratch_path(spark, "registry"))
    if "status" in out:
        return out["status"]
    report = out["report"].select(F.col("run").alias("run_id"), "status", "observations", F.size("learning_curve").alias("epochs"), r("oos_net_sharpe").alias("realised_sharpe"))
    board = out["leaderboard"].select("run_id", r("oos_net_sharpe").alias("engine_sharpe"), "is_baseline")
    known = out["registered"].select(F.col("strategy_name").alias("run_id"), "experiment_id", r(F.col("metrics")["sharpe"]).alias("registered_sharpe"))
    window = out["window"].select(F.date_format("start", "yyyy-MM-dd").alias("start"), F.date_format("end", "yyyy-MM-dd").alias("end")).first()
    return (board.join(report, "run_id").join(known, "run_id", "left")
            .withColumn("start", F.lit(window["start"])).withColumn("end", F.lit(window["end"])))


@query("w15_realised_returns", sql("wi_all index_hist", f"""
    SELECT run, CAST(k + 1 AS BIGINT) AS k, {rd('gross - turnover * 5 / 10000.0', 9)} AS ret FROM (
      SELECT run, k, coalesce(gross, 0) AS gross, coalesce(turnover, 0) AS turnover FROM (SELECT DISTINCT run FROM wi_all) CROSS JOIN (SELECT k FROM cal WHERE k < (SELECT max(k) FROM cal))
      LEFT JOIN g USING (run, k) LEFT JOIN t USING (run, k))""",
    px="SELECT k, symbol, arg_max(close, event_date) AS close FROM index_hist GROUP BY k, symbol",
    g="""SELECT run, w.k, sum(weight * (b.close / a.close - 1)) AS gross FROM wi_all w JOIN px a ON a.k = w.k AND a.symbol = w.symbol
         JOIN px b ON b.k = w.k + 1 AND b.symbol = w.symbol WHERE a.close > 0 GROUP BY run, w.k""",
    t="""SELECT run, k, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) AS turnover
         FROM wi_all a FULL JOIN (SELECT run, k + 1 AS k, symbol, weight FROM wi_all) b USING (run, k, symbol) GROUP BY run, k"""))
def _(spark, d):
    rets = realised_returns(index_weights(spark, d), index_history(spark, d), 5.0, len(MONTHLY))
    return rets.select("run", F.col("k").cast("long").alias("k"), r("ret", 9).alias("ret"))
