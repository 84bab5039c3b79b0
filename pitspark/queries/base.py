"""The market panels derived from the given tables, and the query registry.

The given tables hold no market data, so the panels are views over them:

* prices: one quote per order line. The supplier is the symbol, the shipping
  month the period, and the quote is published ``l_quantity`` days after
  shipping, so a (symbol, month) has many releases. Some combinations of discount
  and tax stand for bad ticks (missing or negative close).
* index prices: five assets, one per order priority; the monthly mean order value
  released once per order status, at different lags.
* macro: monthly mean order value per priority plus a spread series, each
  released twice.
* listings: a supplier lists with its first quote; one with a negative balance
  is delisted at its last.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calendars import Calendar
from ..session import local_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

START, END = "1995-01-01", "2001-12-31"
MONTHLY = Calendar.between(START, END, "monthly")
QUARTERLY = Calendar.between(START, END, "quarterly")
ASSETS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def load_all() -> None:
    for module in ("market", "returns", "strategies", "research", "ingest", "ops", "ladders", "learned"):
        importlib.import_module(f"pitspark.queries.{module}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(column, digits: int = 6):
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits) + F.lit(0.0)


def day(column):
    return F.date_format(column, "yyyy-MM-dd")


# -- panels -------------------------------------------------------------------


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes_of(table(spark, sf_dir, "lineitem"))


def quotes_of(line: DataFrame) -> DataFrame:
    close = 500.0 + F.col("l_extendedprice") / (F.col("l_quantity") * 97.0)
    worst = F.col("l_discount") == 0.1
    return line.select(
        F.col("l_suppkey").cast("string").alias("symbol"),
        F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("event_date"),
        (F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int"))).alias("available_date"),
        F.when(worst & (F.col("l_tax") == 0.0), float("nan")).when(worst & (F.col("l_tax") == 0.08), -close).otherwise(close).alias("close"),
        (F.col("l_linestatus") == "F").alias("is_approximate"))


def index_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    lag = F.when(F.col("o_orderstatus") == "F", 35).when(F.col("o_orderstatus") == "O", 50).otherwise(70)
    return (orders.groupBy(F.col("o_orderpriority").alias("symbol"), month.alias("event_date"), "o_orderstatus")
            .agg((F.avg("o_totalprice") / 97.0).alias("close"))
            .select("symbol", "event_date", (F.col("event_date") + F.make_dt_interval(lag)).alias("available_date"),
                    "close", F.lit(False).alias("is_approximate")))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    level = (orders.groupBy(F.col("o_orderpriority").alias("series"), month.alias("event_date"))
             .agg((F.avg("o_totalprice") / 97.0).alias("value")))
    sign = F.when(F.col("series") == "1-URGENT", F.col("value")).when(F.col("series") == "5-LOW", -F.col("value"))
    spread = (level.filter(F.col("series").isin("1-URGENT", "5-LOW")).groupBy("event_date")
              .agg(F.sum(sign).alias("value"), F.count("*").alias("n")).filter("n = 2")
              .select(F.lit("SPREAD").alias("series"), "event_date", "value"))
    both = level.unionByName(spread)
    release = F.explode(F.array(F.struct(F.lit(45).alias("lag"), F.lit(1.0).alias("factor")),
                                F.struct(F.lit(75).alias("lag"), F.lit(1.01).alias("factor"))))
    return (both.withColumn("release", release)
            .select("series", "event_date", (F.col("event_date") + F.make_dt_interval(F.col("release.lag"))).alias("available_date"),
                    (F.col("value") * F.col("release.factor")).alias("value"), F.lit(False).alias("is_approximate")))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tradable symbols, from the dimension rather than a scan of the quotes."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"))


def assets(spark: SparkSession) -> DataFrame:
    """The configured symbols of the index panel."""
    return local_table(spark, [(a,) for a in ASSETS], "symbol string")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    extent = (table(spark, sf_dir, "lineitem").groupBy("l_suppkey")
              .agg(F.min("l_shipdate").alias("list_date"), F.max("l_shipdate").alias("last_date")))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return (extent.join(supplier, extent.l_suppkey == supplier.s_suppkey)
            .select(F.col("s_suppkey").cast("string").alias("symbol"), "list_date",
                    F.when(F.col("s_acctbal") < 0, F.col("last_date")).alias("delist_date")))


# -- the same panels in SQL ---------------------------------------------------

_CTE = {
    "prices": """
        SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS event_date,
               CAST(l_shipdate + to_days(CAST(l_quantity AS INTEGER)) AS TIMESTAMP) AS available_date,
               CASE WHEN l_discount = 0.1 AND l_tax = 0.0 THEN CAST('NaN' AS DOUBLE)
                    WHEN l_discount = 0.1 AND l_tax = 0.08 THEN -(500.0 + l_extendedprice / (l_quantity * 97.0))
                    ELSE CAST(500.0 + l_extendedprice / (l_quantity * 97.0) AS DOUBLE) END AS close,
               l_linestatus = 'F' AS is_approximate
        FROM lineitem""",
    "index_prices": """
        SELECT o_orderpriority AS symbol, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS event_date,
               CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) + to_days(CASE o_orderstatus WHEN 'F' THEN 35 WHEN 'O' THEN 50 ELSE 70 END) AS available_date,
               avg(o_totalprice) / 97.0 AS close, FALSE AS is_approximate
        FROM orders GROUP BY 1, 2, o_orderstatus""",
    "macro_level": """
        SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS event_date, avg(o_totalprice) / 97.0 AS value
        FROM orders GROUP BY 1, 2""",
    "macro_both": """
        SELECT * FROM macro_level UNION ALL
        SELECT 'SPREAD', u.event_date, u.value - l.value FROM macro_level u JOIN macro_level l
        ON u.event_date = l.event_date AND u.series = '1-URGENT' AND l.series = '5-LOW'""",
    "macro": """
        SELECT series, event_date, event_date + to_days(lag) AS available_date, value * factor AS value, FALSE AS is_approximate
        FROM macro_both, (VALUES (45, 1.0::DOUBLE), (75, 1.01::DOUBLE)) AS releases(lag, factor)""",
    "listings": """
        SELECT CAST(s_suppkey AS VARCHAR) AS symbol, min(l_shipdate) AS list_date,
               CASE WHEN max(s_acctbal) < 0 THEN max(l_shipdate) END AS delist_date
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey""",
    "cal": f"""
        SELECT CAST(row_number() OVER (ORDER BY d) - 1 AS INTEGER) AS k, CAST(d AS TIMESTAMP) AS as_of
        FROM (SELECT last_day(CAST(m AS DATE)) AS d FROM generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL 1 MONTH) AS g(m))""",
    "qcal": """
        SELECT CAST(row_number() OVER (ORDER BY as_of) - 1 AS INTEGER) AS k, as_of FROM cal WHERE month(as_of) % 3 = 0""",
    # J1 and J2, the brute-force way: every visible row of every date, then the newest
    "asof_px": """
        SELECT k, as_of, symbol, event_date, available_date, close FROM (
          SELECT c.k, c.as_of, p.*, row_number() OVER (PARTITION BY c.k, p.symbol
                 ORDER BY p.available_date DESC, p.event_date DESC, p.close DESC) AS rn
          FROM cal c JOIN prices p ON p.available_date <= c.as_of) WHERE rn = 1""",
    "index_asof": """
        SELECT k, as_of, symbol, event_date, available_date, close FROM (
          SELECT c.k, c.as_of, p.*, row_number() OVER (PARTITION BY c.k, p.symbol
                 ORDER BY p.available_date DESC, p.event_date DESC, p.close DESC) AS rn
          FROM cal c JOIN index_prices p ON p.available_date <= c.as_of) WHERE rn = 1""",
    "macro_asof": """
        SELECT k, as_of, series, event_date, available_date, value FROM (
          SELECT c.k, c.as_of, m.*, row_number() OVER (PARTITION BY c.k, m.series
                 ORDER BY m.event_date DESC, m.available_date DESC, m.value DESC) AS rn
          FROM cal c JOIN macro m ON m.available_date <= c.as_of) WHERE rn = 1""",
    "hist": """
        SELECT k, as_of, symbol, event_date, close FROM (
          SELECT c.k, c.as_of, p.symbol, p.event_date, p.close, row_number() OVER (PARTITION BY c.k, p.symbol, p.event_date
                 ORDER BY p.available_date DESC, p.close DESC) AS rn
          FROM cal c JOIN prices p ON p.available_date <= c.as_of) WHERE rn = 1 AND NOT isnan(close)""",
    "index_hist": """
        SELECT k, as_of, symbol, event_date, close FROM (
          SELECT c.k, c.as_of, p.symbol, p.event_date, p.close, row_number() OVER (PARTITION BY c.k, p.symbol, p.event_date
                 ORDER BY p.available_date DESC, p.close DESC) AS rn
          FROM cal c JOIN index_prices p ON p.available_date <= c.as_of) WHERE rn = 1""",
    "legs": """
        SELECT a.k, a.symbol, a.close AS p0, b.close AS p1, b.close / a.close - 1 AS leg
        FROM asof_px a JOIN asof_px b ON a.symbol = b.symbol AND b.k = a.k + 1
        WHERE NOT isnan(a.close) AND a.close > 0 AND NOT isnan(b.close) AND b.close > 0""",
    "index_legs": """
        SELECT a.k, a.symbol, a.close AS p0, b.close AS p1, b.close / a.close - 1 AS leg
        FROM index_asof a JOIN index_asof b ON a.symbol = b.symbol AND b.k = a.k + 1 WHERE a.close > 0 AND b.close > 0""",
}

_NEEDS = {
    "macro_both": ["macro_level"], "macro": ["macro_both"], "qcal": ["cal"],
    "asof_px": ["cal", "prices"], "index_asof": ["cal", "index_prices"], "macro_asof": ["cal", "macro"],
    "hist": ["cal", "prices"], "index_hist": ["cal", "index_prices"],
    "legs": ["asof_px"], "index_legs": ["index_asof"],
}


def cte(name: str, sql: str, needs: list[str]) -> None:
    """Register a further building block for the SQL twins."""
    _CTE[name], _NEEDS[name] = sql, needs


def sql(needs: str, body: str, **local: str) -> str:
    """WITH the named blocks in dependency order, then the query's own, then the body."""
    order: list[str] = []

    def visit(name):
        for other in _NEEDS.get(name, []):
            visit(other)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    parts = [f"{n} AS ({_CTE[n]})" for n in order] + [f"{n} AS ({text})" for n, text in local.items()]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


D = "strftime({0}, '%Y-%m-%d')"


def rd(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"


# walk-forward 36 / 12 / 12 over the monthly calendar, the union over folds
_CTE["walk"] = """SELECT 0 AS fold, min(as_of) AS start FROM cal UNION ALL
        SELECT fold + 1, start + INTERVAL 12 MONTH FROM walk WHERE fold < 100"""
_CTE["folds"] = """SELECT fold, start, start + INTERVAL 36 MONTH AS split, start + INTERVAL 36 MONTH + INTERVAL 12 MONTH AS stop
        FROM walk WHERE start + INTERVAL 36 MONTH <= (SELECT max(as_of) FROM cal)"""
_CTE["seg"] = """SELECT 'full' AS segment, k FROM cal
        UNION SELECT 'in_sample', k FROM cal JOIN folds ON as_of >= start AND as_of < split
        UNION SELECT 'out_of_sample', k FROM cal JOIN folds ON as_of >= split AND as_of < stop"""
_NEEDS.update({"walk": ["cal"], "folds": ["walk"], "seg": ["folds"]})


def metrics_blocks(source: str, ppy: float = 12.0, by: str = "run, segment") -> dict[str, str]:
    """A1 in SQL over a block (run, segment, k, ret, turnover); the result block is ``metric``."""
    return {
        "m_wealth": f"SELECT *, product(1 + ret) OVER (PARTITION BY {by} ORDER BY k ROWS UNBOUNDED PRECEDING) AS wealth FROM {source} WHERE ret IS NOT NULL",
        "m_path": f"SELECT *, wealth / max(wealth) OVER (PARTITION BY {by} ORDER BY k ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM m_wealth",
        "m_stats": f"SELECT {by}, count(*) AS periods, avg(ret) AS mean, coalesce(stddev_samp(ret), 0) AS std, arg_max(wealth, k) AS final, min(drawdown) AS max_drawdown FROM m_path GROUP BY {by}",
        "m_turn": f"SELECT {by}, sum(turnover) AS turnover FROM {source} GROUP BY {by}",
        "metric": f"""SELECT {by}, periods, final - 1 AS cumulative_return,
             CASE WHEN final <= 0 THEN -1.0 ELSE pow(final, {ppy} / periods) - 1 END AS annualized_return, std * sqrt({ppy}) AS annualized_vol,
             max_drawdown, CASE WHEN std > 0 THEN mean / std * sqrt({ppy}) ELSE 0 END AS sharpe, turnover
             FROM m_stats JOIN m_turn USING ({by})""",
    }


METRIC_COLUMNS = ["cumulative_return", "annualized_return", "annualized_vol", "max_drawdown", "sharpe", "turnover"]
METRIC_SQL = "CAST(periods AS BIGINT) AS periods, " + ", ".join(f"{rd(c)} AS {c}" for c in METRIC_COLUMNS)


def metric_output(metrics: DataFrame, *keys: str) -> DataFrame:
    return metrics.select(*keys, "periods", *[r(c).alias(c) for c in METRIC_COLUMNS])


def backtest_blocks(weights: str, legs: str, bps: float, cal: str = "cal", ppy: float = 12.0) -> dict[str, str]:
    """B1 in SQL over a block (run, k, symbol, weight): the blocks ``port`` and ``metric``."""
    last = f"(SELECT max(k) FROM {cal})"
    blocks = {
        "b_runs": f"SELECT run, k FROM (SELECT DISTINCT run FROM {weights}) r, {cal}",
        "b_gross": f"SELECT run, k, sum(weight * leg) AS gross FROM {weights} JOIN {legs} USING (k, symbol) GROUP BY run, k",
        "b_turn": f"""SELECT run, k, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) AS turnover
             FROM {weights} a FULL JOIN (SELECT run, k + 1 AS k, symbol, weight FROM {weights}) b USING (run, k, symbol) GROUP BY run, k""",
        "port": f"""SELECT r.run, r.k, coalesce(t.turnover, 0) AS turnover,
             CASE WHEN r.k < {last} THEN coalesce(g.gross, 0) - greatest(coalesce(t.turnover, 0), 0) * {bps} / 10000.0 END AS ret
             FROM b_runs r LEFT JOIN b_gross g USING (run, k) LEFT JOIN b_turn t USING (run, k)""",
        "b_seg": "SELECT p.*, segment FROM port p JOIN seg USING (k)",
    }
    blocks.update(metrics_blocks("b_seg", ppy))
    return blocks
