"""Run records and the experiment registry as append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import canonical_hash, oos_net
from ..schemas import EXPERIMENT
from ..session import read_if_there

CLAIM = "no_alpha_claim"


def checked_sharpe(metrics: Column) -> Column:
    """Out-of-sample net Sharpe of a record; null when it has none, an error when it is not finite."""
    value = oos_net(metrics)["sharpe"]
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.raise_error("a run record needs a finite out-of-sample net Sharpe").cast("double")).otherwise(value)


def prepare_runs(records: DataFrame) -> DataFrame:
    """Generated ids where missing, Sharpe extracted, and the place in the log: time of the write, then row of the write.

    One driver writes a log, so times of writes do not depend on two clocks.
    """
    run_id = F.when(F.length(F.coalesce("run_id", F.lit(""))) > 0, F.col("run_id")).otherwise(F.replace(F.uuid(), F.lit("-"), F.lit("")))
    return (records.withColumn("run_id", run_id).withColumn("oos_net_sharpe", checked_sharpe(F.col("metrics")))
            .withColumn("write_seq", F.struct(F.unix_micros(F.current_timestamp()).alias("at"), F.monotonically_increasing_id().alias("row"))))


def log_runs(records: DataFrame, path: str) -> None:
    """Append; the newest write of a run id replaces the older ones at read time."""
    prepare_runs(records).write.mode("append").parquet(path)


def latest_runs(log: DataFrame) -> DataFrame:
    """One row per run id, the last one written."""
    others = [c for c in log.columns if c not in ("run_id", "write_seq")]
    newest = log.groupBy("run_id").agg(F.max_by(F.struct(*others), "write_seq").alias("row"))
    return newest.select("run_id", "row.*")


def read_runs(spark: SparkSession, path: str, schema) -> DataFrame:
    return latest_runs(spark.read.schema(schema).parquet(path))


def get_run(runs: DataFrame, run_id: str) -> DataFrame:
    """The record of one id, an error when there is none. The filter reaches the files."""
    found = runs.filter(F.col("run_id") == run_id)
    if found.isEmpty():
        raise KeyError(run_id)
    return found


# -- experiments --------------------------------------------------------------


def experiment_id(family: Column, strategy: Column, config: Column) -> Column:
    """16 hex digits over (config sorted by key, family, strategy)."""
    entries = F.map_from_entries(F.array_sort(F.map_entries(config)))
    return canonical_hash(F.struct(entries.alias("config"), F.trim(family).alias("model_family"), F.trim(strategy).alias("strategy_name")), 16)


def new_experiments(entries: DataFrame, registered: DataFrame) -> DataFrame:
    """Entries whose id is not registered yet, once each."""
    refused = F.raise_error(F.lit("entries of an experiment registry carry the claim no_alpha_claim")).cast("string")
    blank = (F.trim("model_family") == "") | (F.trim("strategy_name") == "")
    checked = F.when(F.col("claim_boundary") != CLAIM, refused).when(
        blank, F.raise_error(F.lit("an entry names its family and its strategy")).cast("string"))
    known = entries.withColumn("claim_boundary", F.coalesce(checked, F.col("claim_boundary")))
    named = known.withColumn("experiment_id", experiment_id(F.col("model_family"), F.col("strategy_name"), F.col("config")))
    # of entries with one id the first in the order given counts
    others = [c for c in named.columns if c != "experiment_id"]
    first = (named.withColumn("entry", F.monotonically_increasing_id()).groupBy("experiment_id")
             .agg(F.min_by(F.struct(*others), "entry").alias("row")).select("experiment_id", "row.*"))
    return first.join(registered.select("experiment_id"), "experiment_id", "left_anti").select(*EXPERIMENT.fieldNames())


def register(entries: DataFrame, path: str) -> None:
    """Append to the JSON-lines registry."""
    spark = entries.sparkSession
    new_experiments(entries, read_registry(spark, path)).write.mode("append").json(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """S12"""
    found = read_if_there(lambda: spark.read.schema(EXPERIMENT).json(path))
    return spark.createDataFrame([], EXPERIMENT) if found is None else found


def ordered(registry: DataFrame) -> DataFrame:
    """O4"""
    return registry.orderBy("model_family", "strategy_name", "experiment_id")


def registry_from_runs(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entries for (model_family, strategy_name, config, run_ids, tags).

    Every listed run must exist and carry the claim; the first one supplies the metrics.
    """
    listed = wanted.select("*", F.posexplode("run_ids").alias("place", "run_id"))
    facts = runs.select("run_id", F.col("strategy_metadata")["claim_boundary"].alias("claim"), oos_net(F.col("metrics")).alias("m"))
    joined = listed.join(facts, "run_id", "left")
    wrong = F.when(F.coalesce(F.col("claim"), F.lit("")) != CLAIM,
                   F.raise_error(F.concat(F.lit("run missing or without no_alpha_claim: "), F.col("run_id"))).cast("string"))
    joined = joined.withColumn("claim", F.coalesce(wrong, F.col("claim")))
    names = ["cumulative_return", "annualized_return", "annualized_vol", "max_drawdown", "sharpe", "turnover"]
    first = F.min_by("m", "place")
    out = joined.groupBy("model_family", "strategy_name", "config", "run_ids", "tags").agg(first.alias("m"), F.max("claim").alias("claim_boundary"))
    return out.select("model_family", "strategy_name", "config", "run_ids",
                      F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"m.{n}"))]).alias("metrics"), "claim_boundary", "tags")
