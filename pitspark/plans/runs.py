"""Run records: backtest results shaped for storing, ranking and grouping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import oos_net
from ..operators.backtest import Backtest, run_backtest
from ..operators.ordering import numbered
from ..session import local_table, scratch_path
from ..sources.runstore import CLAIM, checked_sharpe, latest_runs, log_runs
from ..schemas import METRIC


def as_records(metrics: DataFrame, config: Backtest, metadata: Mapping[str, Mapping[str, str]],
               baselines: Sequence[str] = ()) -> DataFrame:
    """Metric rows to one record per run."""
    spark = metrics.sparkSession
    packed = metrics.groupBy("run").agg(F.array_sort(F.collect_list(F.struct(*METRIC.fieldNames()))).alias("metrics"))
    named = {**{name: {} for name in baselines}, **metadata}
    facts = spark.createDataFrame([(name, dict(about), name in baselines) for name, about in named.items()],
                                  "run string, strategy_metadata map<string,string>, is_baseline boolean")
    settings = {"rebalance": config.rebalance, "mode": config.mode, "charged_bps": str(config.costs.charged_bps),
                "start": str(config.calendar.dates[0].date()), "end": str(config.calendar.dates[-1].date())}
    stated = F.create_map(*[F.lit(x) for item in settings.items() for x in item])
    joined = packed.join(F.broadcast(facts), "run", "left")
    return joined.select(F.col("run").alias("run_id"), F.col("run").alias("strategy_name"), "strategy_metadata", stated.alias("config"),
                         "metrics", F.coalesce("is_baseline", F.lit(False)).alias("is_baseline"))


def records(weights: DataFrame, prices: DataFrame, config: Backtest, metadata: Mapping[str, Mapping[str, str]],
            baselines: Sequence[str] = ()) -> DataFrame:
    """All runs of a weights table through one backtest."""
    named = local_table(weights.sparkSession, [(n,) for n in metadata], "run string")
    _, metrics = run_backtest(weights, prices, config, named)
    return as_records(metrics, config, metadata, baselines)


def run_and_log(spark: SparkSession, runs: DataFrame, path: str | None = None) -> DataFrame:
    """B2: append the records to the run log and read the stored state back."""
    path = path or scratch_path(spark, "runs")
    log_runs(runs, path)
    return latest_runs(spark.read.parquet(path))


def leaderboard(runs: DataFrame, metric: str = "oos_net_sharpe", descending: bool = True) -> DataFrame:
    """O1: only the out-of-sample net Sharpe ranks; runs without one come last either way."""
    if metric != "oos_net_sharpe":
        raise ValueError(f"unsupported leaderboard metric: {metric}")
    rows = runs.select("run_id", "strategy_name", checked_sharpe(F.col("metrics")).alias(metric), "is_baseline")
    order = F.desc_nulls_last(metric) if descending else F.asc_nulls_last(metric)
    return numbered(rows, order, F.asc("run_id")).orderBy("rank")


def leaderboard_records(runs: DataFrame) -> DataFrame:
    """Leaderboard rows with their records."""
    board = leaderboard(runs).select("run_id", "oos_net_sharpe", "rank")
    return board.join(runs, "run_id")


def require_claim(runs: DataFrame) -> DataFrame:
    """An explicit claim other than ``no_alpha_claim`` stops the job; silence is accepted."""
    claim = F.col("strategy_metadata")["claim_boundary"]
    wrong = F.when(claim.isNotNull() & (claim != CLAIM), F.raise_error(F.concat(F.lit("overclaiming record: "), F.col("run_id"))).cast("string"))
    return runs.withColumn("run_id", F.coalesce(wrong, F.col("run_id")))


def required_sharpe() -> Column:
    value = oos_net(F.col("metrics"))["sharpe"]
    return F.when(value.isNull(), F.raise_error("the comparison needs an out-of-sample net Sharpe").cast("double")).otherwise(value)


def ranked_rows(runs: DataFrame) -> DataFrame:
    """O2: comparison rows, best first, baseline kept in sight."""
    rows = require_claim(runs).select("run_id", "strategy_name", required_sharpe().alias("oos_net_sharpe"), "is_baseline")
    return numbered(rows, F.desc("oos_net_sharpe"), F.asc("run_id")).orderBy("rank")


def family_scores(runs: DataFrame, families: DataFrame) -> DataFrame:
    """(model_family, run_ids) exploded and joined to the records; a missing run is an error."""
    wanted = families.select("model_family", F.explode("run_ids").alias("run_id"))
    joined = wanted.join(require_claim(runs), "run_id", "left")
    missing = F.when(F.col("metrics").isNull(), F.raise_error(F.concat(F.lit("unknown run "), F.col("run_id"))).cast("double"))
    return joined.select("model_family", "run_id", "strategy_name", F.coalesce(missing, required_sharpe()).alias("oos_net_sharpe"), "is_baseline")


def family_evaluation(scores: DataFrame) -> DataFrame:
    """Families, baselines and the number of scores; no baseline in sight is an error."""
    out = scores.agg(
        F.array_sort(F.collect_set("model_family")).alias("families"),
        F.array_sort(F.collect_set(F.when(F.col("is_baseline"), F.col("run_id")))).alias("baseline_run_ids"),
        F.bool_or("is_baseline").alias("visible"), F.count("*").alias("scores"), F.max("oos_net_sharpe").alias("best"))
    blind = F.when(~F.coalesce("visible", F.lit(False)), F.raise_error("the evaluation needs a visible baseline row").cast("string"))
    return out.select(F.coalesce(blind, F.lit(CLAIM)).alias("claim_boundary"), F.lit("out_of_sample_net_only").alias("metric_authority"),
                      "families", "baseline_run_ids", "scores", "best")
