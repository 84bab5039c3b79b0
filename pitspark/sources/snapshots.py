"""The immutable snapshot store: first write of a (source, day) wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SNAPSHOT
from ..session import read_if_there

KEY = ["available_date", "source"]


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Stored snapshots, partitioned by available_date; empty before the first write."""
    stored = read_if_there(lambda: spark.read.schema(SNAPSHOT).option("basePath", path).parquet(path))
    if stored is None:
        return spark.createDataFrame([], SNAPSHOT)
    return stored.withColumn("available_date", F.col("available_date").cast("string")).select(*SNAPSHOT.fieldNames())


def outcomes(records: DataFrame, stored: DataFrame) -> DataFrame:
    """Each distinct (available_date, source) with ``ok`` or ``skip``."""
    known = stored.select(*KEY).distinct().withColumn("known", F.lit(True))
    return records.select(*KEY).distinct().join(known, KEY, "left").select(
        *KEY, F.when(F.col("known"), "skip").otherwise("ok").alias("status"))


def unseen(records: DataFrame, stored: DataFrame) -> DataFrame:
    """The records to write. Of several new ones for a key the earliest capture counts.

    Known keys leave before the payloads are reduced, so a day sent again moves no payload twice.
    """
    others = [c for c in SNAPSHOT.fieldNames() if c not in KEY]
    new = records.join(stored.select(*KEY).distinct(), KEY, "left_anti")
    first = new.groupBy(*KEY).agg(F.min(F.struct("captured_at", *[c for c in others if c != "captured_at"])).alias("row"))
    return first.select(*KEY, "row.*").select(*SNAPSHOT.fieldNames())


def write_snapshots(records: DataFrame, path: str) -> None:
    """Append what is new. Stored rows are never rewritten; a store has one writer at a time.

    A day's rows go to few files: rows are rebalanced by day, and only a large day is split.
    """
    days = records.select("available_date").distinct()
    stored = read_store(records.sparkSession, path).join(days, "available_date", "left_semi")
    (unseen(records, stored).hint("rebalance", "available_date")
     .write.mode("append").partitionBy("available_date").parquet(path))


def manifest(results: DataFrame) -> DataFrame:
    """Outcome counts of each backfill run; the status of each source stays in ``results``."""
    return results.groupBy("run").agg(
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "skip").alias("skip"),
        F.count_if(F.col("status").startswith("fail")).alias("fail"), F.count("*").alias("sources")).withColumn(
            "claim_boundary", F.lit("no_alpha_claim"))


def write_manifest(results: DataFrame, path: str) -> None:
    """S16 as files: the counts per run and, beside them, the outcome of every source."""
    manifest(results).write.mode("overwrite").json(f"{path}/manifest")
    results.select("run", "source", "status").write.mode("overwrite").partitionBy("run").json(f"{path}/sources")
