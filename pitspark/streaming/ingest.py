"""Continuous ingest, quarantine, latest revisions and gap filling.

Each stream runs with the available-now trigger, keeps its progress in a checkpoint
under the shared folder and writes through ``foreachBatch``, so a lost executor or a
restart replays a batch without writing a record twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calendars import business_days
from ..operators.quality import close_row_problem
from ..schemas import SNAPSHOT
from ..session import read_if_there, scratch_path
from ..sources.snapshots import write_snapshots
from ..sources.vintage import envelope, gap_slices, slices_to_csv


def stream_snapshots(spark: SparkSession, landing: str) -> DataFrame:
    """Landed JSON records as a stream."""
    return (spark.readStream.schema(SNAPSHOT).option("multiLine", True).option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.json").json(landing))


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over everything that has arrived, then stop."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def ingest_snapshots(stream: DataFrame, store: str, checkpoint: str) -> None:
    """First write wins. The stored keys are looked up per batch, so they are never forgotten."""
    drain(stream, lambda batch, _: write_snapshots(batch, store), checkpoint)


def split_batch(batch: DataFrame, batch_id: int, good_path: str, bad_path: str) -> None:
    """Rows with a problem go to the quarantine, the others on; one bad source stops nothing.

    Each batch owns its folder, so a replay overwrites what it wrote before.
    """
    judged = batch.withColumn("problem", close_row_problem(F.col("symbol"), F.col("event_date"), F.col("close")))
    judged.filter("problem is null").drop("problem").write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
    judged.filter("problem is not null").write.mode("overwrite").parquet(f"{bad_path}/batch={batch_id}")


def latest_revisions(quotes: DataFrame) -> DataFrame:
    """The newest release of each (symbol, event_date)."""
    newest = F.max(F.struct("available_date", "close")).alias("row")
    return quotes.groupBy("symbol", "event_date").agg(newest).select("symbol", "event_date", "row.*")


def merge_revisions(batch: DataFrame, batch_id: int, path: str, compact_every: int = 16) -> None:
    """What a batch knows of each (symbol, event_date), written beside what is known already.

    The stream itself keeps no state. A batch adds one row per key of its own to the log, and
    every ``compact_every`` batches log and base become a new base of one row per key, so at
    most so many batches are ever read on top of it and a row is rewritten once per that many
    batches. A base counts once its mark is written and is not written again; a replayed batch
    overwrites its own log, and one that ended half-way leaves no base that is read.
    """
    latest_revisions(batch).write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")
    if (batch_id + 1) % compact_every == 0 and compacted_upto(batch.sparkSession, path) < batch_id:
        read_revisions(batch.sparkSession, path).write.mode("overwrite").parquet(f"{path}/base/upto={batch_id}")
        marks = batch.sparkSession.range(1).select(F.lit(batch_id).cast("long").alias("upto"))
        marks.write.mode("overwrite").parquet(f"{path}/marks/at={batch_id}")


def compacted_upto(spark: SparkSession, path: str) -> int:
    """The last batch that the newest finished base holds, -1 without one."""
    marks = read_if_there(lambda: spark.read.parquet(f"{path}/marks"))
    return -1 if marks is None else marks.agg(F.max("upto")).head()[0]


def revision_parts(spark: SparkSession, path: str) -> DataFrame:
    """The rows behind :func:`read_revisions`: the newest base and the batches after it."""
    columns, upto = ["symbol", "event_date", "available_date", "close"], compacted_upto(spark, path)
    log = spark.read.parquet(f"{path}/log").filter(F.col("batch") > upto).select(*columns)
    return log if upto < 0 else log.unionByName(spark.read.parquet(f"{path}/base/upto={upto}").select(*columns))


def read_revisions(spark: SparkSession, path: str) -> DataFrame:
    """The newest release of each key; a later one supersedes, whichever batch brought it."""
    return latest_revisions(revision_parts(spark, path))


def missing_days(span: DataFrame, captured: DataFrame) -> DataFrame:
    """T4: expected business days without a capture."""
    return business_days(span).join(captured.select(F.to_date("day").alias("day")).distinct(), "day", "left_anti")


def fill_gaps(observations: DataFrame, days: DataFrame, window_since: str, store: str) -> None:
    """T4: rebuild each missing day from what its window holds, marked approximate, and store it."""
    if days.isEmpty():
        return
    payloads = slices_to_csv(gap_slices(observations, days, window_since))
    write_snapshots(envelope(payloads, "gap_fill", window_since=window_since), store)


# -- the streams over the given tables ----------------------------------------


def _table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_event_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.snapshots import read_store

    events = _table_stream(spark, sf_dir, "events")
    records = events.select(
        F.concat(F.lit("event:"), "event_type").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("available_date"),
        F.lit(False).alias("is_approximate"), F.lpad(F.col("event_id").cast("string"), 20, "0").alias("captured_at"),
        F.to_json(F.struct(F.col("event_id").alias("id"), "value")).alias("raw"), F.date_format("ts", "yyyy-MM-dd").alias("event_date"),
        *[F.lit(None).cast(SNAPSHOT[c].dataType).alias(c) for c in ("backfill", "gap_fill", "gap_window_since", "history_start")])
    store = scratch_path(spark, "store")
    ingest_snapshots(records.select(*SNAPSHOT.fieldNames()), store, scratch_path(spark, "progress"))
    return read_store(spark, store)


def run_quarantine(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = _table_stream(spark, sf_dir, "events")
    rows = events.select("event_type", F.col("user_id").cast("string").alias("symbol"), F.date_format("ts", "yyyy-MM-dd").alias("event_date"),
                         F.when(F.col("value") >= 1, F.col("value")).otherwise(-F.col("value")).alias("close"))
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "quarantine")
    drain(rows, lambda batch, i: split_batch(batch, i, good, bad), scratch_path(spark, "progress"))
    return spark.read.parquet(good), spark.read.parquet(bad)


def run_latest_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..queries.base import quotes_of

    path = scratch_path(spark, "revisions")
    stream = quotes_of(_table_stream(spark, sf_dir, "lineitem"))
    drain(stream, lambda batch, i: merge_revisions(batch, i, path), scratch_path(spark, "progress"))
    return read_revisions(spark, path)
