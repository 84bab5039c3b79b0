"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

SHUFFLES_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "pitspark", scratch: str = "/tmp/pitspark") -> SparkSession:
    """A single-JVM session for tests and the bench; a cluster brings its own, with ``spark.checkpoint.dir`` set."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", f"{scratch}/{uuid.uuid4().hex}")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` as the session has it.

    Where it is unset, a folder of the warehouse, which driver and executors share as well. On a
    cluster a folder of the driver's own disk is refused: executors would write to theirs.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    folder = (spark.conf.get("spark.sql.warehouse.dir") + "/scratch").rstrip("/")
    own_disk = folder.startswith("file:") or "://" not in folder
    if own_disk and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Unlike a cached block, the files outlive a lost executor, so later stages
    never recompute the plan behind them.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries begun in here are removed when each ends, not when the driver collects its garbage.

    For steps that are written and read back, and whose plans do not run again.
    """
    before = spark.conf.get(SHUFFLES_REMOVED, None)
    spark.conf.set(SHUFFLES_REMOVED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_REMOVED)
        else:
            spark.conf.set(SHUFFLES_REMOVED, before)


def read_if_there(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What ``read`` reads, or nothing where its path has not been written yet."""
    try:
        return read()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) else f"double('{value}')"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, datetime):
        return f"TIMESTAMP_NTZ'{value.isoformat(sep=' ')}'"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of flat values as a local relation, which the optimizer can fold.

    Rows handed to ``createDataFrame`` become a Python RDD instead and cost a job.
    """
    if not rows:
        return spark.createDataFrame([], schema)
    fields = [part.strip().split(" ", 1) for part in schema.split(",")]
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    columns = ", ".join(f"CAST(c{i} AS {kind}) AS `{name}`" for i, (name, kind) in enumerate(fields))
    names = ", ".join(f"c{i}" for i in range(len(fields)))
    return spark.sql(f"SELECT {columns} FROM VALUES {values} AS t({names})")
