"""Price ladders: buying in steps below a starting price within a budget.

Plans are rows (plan, budget, price_init, price_final, times, min_increment, param,
init_units). Everything a ladder needs stands in its row, so the scaling pass is column
expressions over the row and only the running sums meet a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import round_to_step

METHODS = ("arithmetic", "geometric")
#: distance of a geometric factor from one within which closed forms lose digits
NEAR_ONE = 0.05


def _step() -> Column:
    return F.abs(F.col("price_init") - F.col("price_final")) / F.col("times")


def _price(level: Column) -> Column:
    """always downwards from the starting price."""
    return F.col("price_init") - _step() * level


def _units(level: Column, method: str) -> Column:
    """Units of a level before scaling."""
    if method not in METHODS:
        raise ValueError(f"unknown ladder method: {method}")
    i = level - 1
    if method == "arithmetic":
        return F.col("init_units") + F.col("param") * i
    return F.col("init_units") * F.pow(F.col("param"), i)


def price_levels(plans: DataFrame) -> DataFrame:
    """(plan, level, price); a plan without a price difference has no levels."""
    levels = plans.withColumn("level", F.explode(F.sequence(F.lit(1), F.col("times"))))
    priced = levels.select("plan", "level", "price_init", _price(F.col("level").cast("double")).alias("price"))
    return priced.filter("price <> price_init").drop("price_init")


def unit_ladder(plans: DataFrame, method: str = "arithmetic") -> DataFrame:
    """F13 / F14 at scale one: (plan, level, price, units)."""
    levels = plans.withColumn("level", F.explode(F.sequence(F.lit(1), F.col("times"))))
    i = F.col("level").cast("double")
    return levels.select("plan", "level", _price(i).alias("price"), _units(i, method).alias("units"))


def _cost(method: str) -> Column:
    """Cost of the unscaled ladder: starting price times the sum of units, less the step times the sum of level times units.

    Both sums have closed forms. The geometric ones lose digits near a factor of one; there, and where
    they overflow or levels run downwards, the levels are folded.
    """
    n, first, param = F.col("times").cast("double"), F.col("init_units"), F.col("param")
    if method == "arithmetic":
        units = n * first + param * n * (n - 1) / 2
        by_level = first * n * (n + 1) / 2 + param * (n - 1) * n * (n + 1) / 3
        safe = n >= 1
    else:
        power, less = F.pow(param, n), F.nullif(param - 1, F.lit(0.0))
        total = (power - 1) / less
        units, by_level = first * total, first * (n * power - total) / less
        safe = (n >= 1) & (F.abs(less) > NEAR_ONE) & (F.abs(power) < 1e200)
    numbers = F.sequence(F.lit(1), F.col("times"))
    folded = F.aggregate(numbers, F.lit(0.0), lambda total, i: total + _price(i.cast("double")) * _units(i.cast("double"), method))
    return F.when(safe, F.col("price_init") * units - _step() * by_level).otherwise(folded)


def scaled_plans(plans: DataFrame, method: str = "arithmetic") -> DataFrame:
    """F15, first pass: ``scale`` that makes the unrounded ladder cost the budget."""
    if method not in METHODS:
        raise ValueError(f"unknown ladder method: {method}")
    costed = plans.withColumn("_cost", _cost(method))
    return costed.withColumn("scale", F.when(F.col("_cost") != 0, F.col("budget") / F.col("_cost"))).drop("_cost")


def ladder(plans: DataFrame, method: str = "arithmetic") -> DataFrame:
    """F15-F17 + W12: levels with rounded units, amounts, shares and running sums."""
    levels = scaled_plans(plans, method).withColumn("level", F.explode(F.sequence(F.lit(1), F.col("times"))))
    i = F.col("level").cast("double")
    sized = levels.select("plan", "level", "price_init", _price(i).alias("price"),
                          round_to_step(_units(i, method) * F.col("scale"), F.col("min_increment")).alias("units"))
    sized = sized.filter("price <> price_init").withColumn("amount", F.col("price") * F.col("units"))
    whole = Window.partitionBy("plan")
    running = whole.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    share = F.col("amount") / F.col("total") * 100.0
    out = sized.withColumn("total", F.sum("amount").over(whole)).withColumn("share_pct", share)
    return out.select(
        "plan", "level", "price", "units", "amount", "share_pct",
        F.sum("share_pct").over(running).alias("cumulative_pct"), F.sum("amount").over(running).alias("cumulative_amount"),
        F.sum("units").over(running).alias("cumulative_units"),
        ((F.col("price_init") - F.col("price")) / F.col("price_init") * 100.0).alias("drop_pct"))


def display(levels: DataFrame) -> DataFrame:
    """shown figures carry two decimals."""
    shown = ("share_pct", "cumulative_pct", "cumulative_amount", "drop_pct")
    return levels.withColumns({c: F.round(c, 2) for c in shown})


def totals(levels: DataFrame, plans: DataFrame) -> DataFrame:
    """Invested total, units, last price, fall from the start and average cost per plan."""
    sums = levels.groupBy("plan").agg(
        F.sum("amount").alias("total_amount"), F.sum("units").alias("total_units"), F.max_by("price", "level").alias("final_price"))
    start = plans.select("plan", "price_init")
    return sums.join(start, "plan").select(
        "plan", "price_init", "final_price", ((F.col("price_init") - F.col("final_price")) / F.col("price_init") * 100.0).alias("drop_pct"),
        "total_amount", "total_units", F.when(F.col("total_units") != 0, F.col("total_amount") / F.col("total_units")).alias("average_cost"))


def allocate(weights: DataFrame, plans: DataFrame, total_budget: float, method: str = "arithmetic") -> tuple[DataFrame, DataFrame]:
    """(budgets, ladders) of (symbol, weight); a zero budget buys nothing.

    ``plans`` is keyed by symbol; a funded symbol without a plan is an error.
    """
    budgets = weights.select("symbol", (F.col("weight") * total_budget).alias("budget"))
    funded = budgets.filter("budget > 0").join(plans.drop("budget"), "symbol", "left")
    lost = F.when(F.col("price_init").isNull(), F.raise_error(F.concat(F.lit("no ladder plan for "), F.col("symbol"))).cast("double"))
    funded = funded.withColumn("price_init", F.coalesce(lost, F.col("price_init"))).withColumn("plan", F.col("symbol"))
    return budgets, ladder(funded, method)
