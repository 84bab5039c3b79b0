"""Parameterised experiments: a grid of learned forecasters against equal weight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import weights as w
from ..operators.asof import history_asof
from ..operators.backtest import Backtest, Costs, realised_returns
from ..operators.calendars import Calendar, WalkForward
from ..operators.forecast import Network, forecast
from ..operators.universe import cotemporal_dates
from ..session import local_table, materialise
from ..sources.runstore import CLAIM, experiment_id, read_registry, register
from .reports import performance_report
from .runs import leaderboard, records

MIN_DATES = 24


def sweep_weights(forecasts: DataFrame) -> DataFrame:
    """Weights of every network of a sweep; the run is named after its place in the grid."""
    sound = forecasts.groupBy("net", "k").agg(F.bool_and(F.col("status") == "ok").alias("sound"))
    raw = forecasts.join(sound, ["net", "k"]).withColumn("weight", F.when(F.col("sound"), F.col("expected_return")).otherwise(0.0))
    scaled = w.normalise(raw, ["net", "k"])
    return scaled.select(F.concat(F.lit("learned_"), F.col("net").cast("string")).alias("run"), "k", "symbol", "weight")


def run_experiment(prices: DataFrame, symbols: Sequence[str], nets: Sequence[Network], rebalance: str = "monthly",
                   commission_bps: float = 5.0, periods_per_year: int = 12, registry: str | None = None) -> dict[str, DataFrame]:
    """Leaderboard, realised performance report, registry entries and window of a grid.

    With a ``registry`` the entries are appended there and read back as ``registered``.

    Thin data gives a single status table instead.
    """
    spark = prices.sparkSession
    names = local_table(spark, [(s,) for s in symbols], "symbol string")
    mine = prices.join(F.broadcast(names), "symbol", "left_semi")
    seen = materialise(mine.select("symbol", "event_date").distinct(), "dates")
    found = sorted(row[0] for row in seen.select("symbol").distinct().collect())
    dates = cotemporal_dates(seen, names)
    count = dates.count()
    if len(found) < 2 or count < MIN_DATES:
        reason = "fewer_than_2_assets" if len(found) < 2 else "thin_cotemporal_history"
        return {"status": spark.createDataFrame([("insufficient_data", reason, CLAIM, count)],
                                                "status string, reason string, claim_boundary string, cotemporal_months long")}
    common = Calendar.collect(dates.select(F.col("event_date").alias("as_of")))
    config = Backtest(Calendar.between(common.dates[0], common.dates[-1], rebalance), rebalance, "net",
                      Costs(commission_bps=commission_bps), WalkForward(36, 12, 12))
    present = local_table(spark, [(s,) for s in found], "symbol string")

    # ranking: the engine on its own calendar
    guesses, _ = forecast(history_asof(mine, config.calendar), found, config.calendar, nets)
    table = sweep_weights(guesses).unionByName(w.equal_weight(present, config.calendar, "baseline"))
    about = {f"learned_{i}": {"claim_boundary": CLAIM, "framework": "reference"} for i in range(len(nets))} | {"baseline": {}}
    runs = records(table, mine, config, about, ["baseline"])

    # statistics: weights held from one common date to the next
    history = history_asof(mine, common)
    guesses, trace = forecast(history, found, common, nets)
    held = sweep_weights(guesses).unionByName(w.equal_weight(present, common, "baseline"))
    # the report reads the series three times
    realised = materialise(realised_returns(held, history, commission_bps, len(common)), "realised")
    last = F.lit(len(common) - 1)
    curves = trace.filter(F.col("k") == last).groupBy("net").agg(F.sort_array(F.collect_list(F.struct("epoch", "loss"))).alias("p")).select(
        F.concat(F.lit("learned_"), F.col("net").cast("string")).alias("run"), F.col("p.loss").alias("learning_curve"))
    report = performance_report(realised, 12, periods_per_year, curves)

    settings = [(f"learned_{i}", {"lookback": str(n.lookback), "hidden_units": str(n.hidden), "epochs": str(n.epochs), "seed": str(n.seed), "rebalance": rebalance})
                for i, n in enumerate(nets)]
    realised_sharpe = report.filter("status = 'ok'").select(F.col("run").alias("run_id"), F.create_map(F.lit("sharpe"), "oos_net_sharpe").alias("metrics"))
    entries = spark.createDataFrame(settings, "run_id string, config map<string,string>").join(realised_sharpe, "run_id", "left").select(
        F.lit("learned").alias("model_family"), F.col("run_id").alias("strategy_name"), "config", F.array("run_id", F.lit("baseline")).alias("run_ids"),
        "metrics", F.array(F.lit("experiment")).alias("tags"), F.lit(CLAIM).alias("claim_boundary"))
    span = local_table(spark, [(common.dates[0], common.dates[-1])], "start timestamp_ntz, end timestamp_ntz")
    out = {"leaderboard": leaderboard(runs), "report": report, "entries": entries, "window": span}
    if registry is not None:
        register(entries, registry)
        mine = entries.withColumn("experiment_id", experiment_id(F.col("model_family"), F.col("strategy_name"), F.col("config"))).select("experiment_id")
        out["registered"] = read_registry(spark, registry).join(mine, "experiment_id", "left_semi")
    return out
