"""Order ladders over the parts: one plan per part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ladder
from . import base
from .base import query, r, rd


def plans(spark, d):
    size = F.col("p_size")
    step = F.when(size <= 10, 0.01).when(size <= 20, 0.1).when(size <= 35, 1.0).otherwise(10.0)
    return base.table(spark, d, "part").select(
        F.col("p_partkey").alias("plan"), (F.col("p_retailprice") * 137.0).alias("budget"), F.col("p_retailprice").alias("price_init"),
        (F.col("p_retailprice") * 0.70710678118).alias("price_final"), size.alias("times"), step.alias("min_increment"),
        F.lit(1.1).alias("param"), F.lit(1.0).alias("init_units"))


_PLANS = """WITH plans AS (SELECT p_partkey AS plan, p_retailprice * 137.0 AS budget, p_retailprice AS p0, p_retailprice * 0.70710678118::DOUBLE AS p1, p_size AS n, 1.1::DOUBLE AS param, 1.0::DOUBLE AS u0,
      CASE WHEN p_size <= 10 THEN 0.01 WHEN p_size <= 20 THEN 0.1 WHEN p_size <= 35 THEN 1.0 ELSE 10.0 END::DOUBLE AS step FROM part),
    lv AS (SELECT *, unnest(generate_series(1, n)) AS level FROM plans),
    base AS (SELECT plan, level, budget, step, p0, p0 - abs(p0 - p1) / n * level AS price, u0 + param * (level - 1) AS au, u0 * pow(param, level - 1) AS gu FROM lv),
    scales AS (SELECT plan, max(budget) / sum(price * au) AS ascale, max(budget) / sum(price * gu) AS gscale FROM base GROUP BY plan),
    sized AS (SELECT b.*, ascale, gscale, round_even(greatest(au * ascale, step) * pow(10.0, -trunc(log10(step))), 0) / pow(10.0, -trunc(log10(step))) AS aunits,
      round_even(greatest(gu * gscale, step) * pow(10.0, -trunc(log10(step))), 0) / pow(10.0, -trunc(log10(step))) AS gunits FROM base b JOIN scales USING (plan)),
    """


def _ladder(kind):
    return f"""l AS (SELECT plan, level, p0, price, {kind}units AS units, price * {kind}units AS amount FROM sized),
    t AS (SELECT *, amount / sum(amount) OVER (PARTITION BY plan) * 100 AS share FROM l),
    w AS (SELECT *, sum(share) OVER f AS cshare, sum(amount) OVER f AS camount, sum(units) OVER f AS cunits, (p0 - price) / p0 * 100 AS drop_pct FROM t
      WINDOW f AS (PARTITION BY plan ORDER BY level ROWS UNBOUNDED PRECEDING)) """


@query("f12_price_levels", _PLANS + f"x AS (SELECT 1) SELECT plan, CAST(level AS BIGINT) AS level, {rd('price')} AS price FROM base")
def _(spark, d):
    return ladder.price_levels(plans(spark, d)).select("plan", F.col("level").cast("long").alias("level"), r("price").alias("price"))


@query("f13_arithmetic_units", _PLANS + f"x AS (SELECT 1) SELECT plan, CAST(level AS BIGINT) AS level, {rd('au')} AS units FROM base")
def _(spark, d):
    return ladder.unit_ladder(plans(spark, d)).select("plan", F.col("level").cast("long").alias("level"), r("units").alias("units"))


@query("f14_geometric_units", _PLANS + f"x AS (SELECT 1) SELECT plan, CAST(level AS BIGINT) AS level, {rd('gu')} AS units FROM base")
def _(spark, d):
    return ladder.unit_ladder(plans(spark, d), "geometric").select("plan", F.col("level").cast("long").alias("level"), r("units").alias("units"))


@query("f15_budget_scale", _PLANS + f"x AS (SELECT 1) SELECT plan, {rd('ascale')} AS arithmetic, {rd('gscale')} AS geometric FROM scales")
def _(spark, d):
    both = ladder.scaled_plans(ladder.scaled_plans(plans(spark, d)).withColumnRenamed("scale", "a"), "geometric").withColumnRenamed("scale", "g")
    return both.select("plan", r("a").alias("arithmetic"), r("g").alias("geometric"))


@query("f16_rounded_units", _PLANS + f"x AS (SELECT 1) SELECT plan, CAST(level AS BIGINT) AS level, {rd('gunits')} AS units FROM sized")
def _(spark, d):
    return ladder.ladder(plans(spark, d), "geometric").select("plan", F.col("level").cast("long").alias("level"), r("units").alias("units"))


@query("f17_percentages", _PLANS + _ladder("a") + f"SELECT plan, CAST(level AS BIGINT) AS level, {rd('share')} AS share_pct, {rd('drop_pct')} AS drop_pct FROM w")
def _(spark, d):
    return ladder.ladder(plans(spark, d)).select("plan", F.col("level").cast("long").alias("level"), r("share_pct").alias("share_pct"), r("drop_pct").alias("drop_pct"))


@query("w12_running_ladder", _PLANS + _ladder("a") + f"""SELECT plan, CAST(level AS BIGINT) AS level, {rd('amount', 4)} AS amount, {rd('cshare', 4)} AS cumulative_pct,
    {rd('camount', 4)} AS cumulative_amount, {rd('cunits', 4)} AS cumulative_units FROM w""")
def _(spark, d):
    return ladder.ladder(plans(spark, d)).select("plan", F.col("level").cast("long").alias("level"), *[
        r(c, 4).alias(c) for c in ("amount", "cumulative_pct", "cumulative_amount", "cumulative_units")])


@query("a20_ladder_totals", _PLANS + _ladder("g") + f"""SELECT plan, {rd('arg_max(price, level)')} AS final_price, {rd('sum(amount)', 4)} AS total_amount, {rd('sum(units)', 4)} AS total_units,
    {rd('sum(amount) / sum(units)')} AS average_cost, {rd('arg_max(drop_pct, level)')} AS drop_pct FROM w GROUP BY plan""")
def _(spark, d):
    table = plans(spark, d)
    out = ladder.totals(ladder.ladder(table, "geometric"), table)
    return out.select("plan", r("final_price").alias("final_price"), r("total_amount", 4).alias("total_amount"), r("total_units", 4).alias("total_units"),
                      r("average_cost").alias("average_cost"), r("drop_pct").alias("drop_pct"))


@query("j16_budget_allocation", f"""
    WITH w AS (SELECT CAST(p_partkey AS VARCHAR) AS symbol, greatest(p_size - 10, 0) / sum(greatest(p_size - 10, 0)) OVER () AS weight, p_retailprice AS p0, 12 AS n FROM part),
    b AS (SELECT *, weight * 1000000.0 AS budget FROM w),
    lv AS (SELECT symbol, budget, p0, level, p0 - abs(p0 - p0 * 0.70710678118::DOUBLE) / 12 * level AS price, 1.0 + 2.0 * (level - 1) AS u FROM b, generate_series(1, 12) AS g(level) WHERE budget > 0),
    s AS (SELECT symbol, max(budget) / sum(price * u) AS scale FROM lv GROUP BY symbol),
    l AS (SELECT symbol, budget, price * (round_even(greatest(u * scale, 0.01) * 100, 0) / 100) AS amount FROM lv JOIN s USING (symbol))
    SELECT b.symbol, {rd('max(b.budget)')} AS budget, count(amount) AS levels, {rd('coalesce(sum(amount), 0)', 4)} AS amount FROM b LEFT JOIN l USING (symbol) GROUP BY b.symbol""")
def _(spark, d):
    part = base.table(spark, d, "part")
    raw = F.greatest(F.col("p_size") - 10, F.lit(0))
    total = part.agg(F.sum(raw)).scalar()
    weights = part.select(F.col("p_partkey").cast("string").alias("symbol"), (raw / total).alias("weight"))
    asset_plans = part.select(
        F.col("p_partkey").cast("string").alias("symbol"), F.col("p_retailprice").alias("price_init"), (F.col("p_retailprice") * 0.70710678118).alias("price_final"),
        F.lit(12).alias("times"), F.lit(0.01).alias("min_increment"), F.lit(2.0).alias("param"), F.lit(1.0).alias("init_units"))
    budgets, levels = ladder.allocate(weights, asset_plans, 1_000_000.0)
    spent = levels.groupBy(F.col("plan").alias("symbol")).agg(F.count("*").alias("levels"), F.sum("amount").alias("amount"))
    return budgets.join(spent, "symbol", "left").select(
        "symbol", r("budget").alias("budget"), F.coalesce("levels", F.lit(0)).cast("long").alias("levels"), r(F.coalesce("amount", F.lit(0.0)), 4).alias("amount"))
