"""Source health, snapshot gates and schedule observation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import local_table

# Source groups a broad snapshot must cover, one source each.
REQUIRED_GROUPS = {
    "fred_macro": ["fred:FEDFUNDS"],
    "fred_price_proxy": ["fred:SP500", "fred:NASDAQCOM", "fred:PCOPPUSDM", "fred:DCOILWTICO", "fred:DEXTAUS"],
    "yahoo_equity": ["yahoo:2330.TW"],
    "yahoo_market": ["yahoo:^TWII"],
    "noaa_macro": ["noaa:oni"],
}
STATUSES = ["ok", "skip", "fail", "dry"]


def source_symbols(records: DataFrame) -> DataFrame:
    """(source, symbol, first, n, last) per symbol; ``first`` is its place in order of arrival.

    A blank source or symbol is an error.
    """
    clean = records.withColumn("source", F.lower(F.trim("source"))).withColumn("symbol", F.trim("symbol"))
    wrong = F.when((F.col("source") == "") | (F.col("symbol") == ""), F.raise_error("a health row names its source and its symbol").cast("string"))
    return clean.withColumn("source", F.coalesce(wrong, F.col("source"))).groupBy("source", "symbol").agg(
        F.min("seq").alias("first"), F.count("*").alias("n"), F.max(F.struct("seq", "status", "default_enabled", "reason")).alias("last"))


def source_health(records: DataFrame) -> DataFrame:
    """Per source the last status, flag and reason by arrival, and how much it reported.

    The symbols themselves stay a table: a source may have any number of them.
    """
    return source_symbols(records).groupBy("source").agg(
        F.max("last").alias("last"), F.sum("n").alias("records"), F.count("*").alias("symbols"),
        F.min(F.struct("first", "symbol")).alias("head")).select(
            "source", "last.status", "last.default_enabled", "last.reason", "records", "symbols", F.col("head.symbol").alias("first_symbol"))


def job_counts(jobs: DataFrame, by: str = "run") -> DataFrame:
    """Outcomes per run."""
    return jobs.groupBy(by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count("*").alias("jobs"))


def snapshot_gate(jobs: DataFrame, reported: DataFrame | None = None, allow_failures: bool = False, by: str = "run") -> DataFrame:
    """Verdict per run: clean, partial, or the reason it is refused.

    ``reported`` holds the counts a run claims for itself; they must match its jobs.
    """
    counted = job_counts(jobs, by)
    if reported is not None:
        claims = reported.select(by, *[F.col(s).alias(f"claimed_{s}") for s in STATUSES])
        counted = counted.join(claims, by, "left")
        agree = F.lit(True)
        for s in STATUSES:
            agree = agree & F.coalesce(F.col(f"claimed_{s}") == F.col(s), F.lit(False))
    else:
        agree = sum((F.col(s) for s in STATUSES), F.lit(0)) == F.col("jobs")
    verdict = F.when(~agree, "counts_do_not_match")
    if not allow_failures:
        verdict = verdict.when(F.col("fail") > 0, "failed_sources")
    verdict = verdict.when(F.col("ok") + F.col("skip") + F.col("dry") == 0, "no_work").when(F.col("fail") > 0, "partial").otherwise("clean")
    return counted.select(by, *STATUSES, "jobs", verdict.alias("verdict"))


def _groups(spark: SparkSession, required: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [(g, s) for g, members in required.items() for s in members]
    return local_table(spark, rows, "group string, source_id string")


def source_quorum(jobs: DataFrame, required: Mapping[str, Sequence[str]] = REQUIRED_GROUPS, by: str = "run") -> DataFrame:
    """(run, group, sources, covered). Any failed source voids the run."""
    groups = _groups(jobs.sparkSession, required)
    done = jobs.filter(F.col("status").isin("ok", "skip")).join(F.broadcast(groups), "source_id").groupBy(by, "group").agg(
        F.sort_array(F.collect_set("source_id")).alias("sources"))
    runs = jobs.groupBy(by).agg(F.count_if(F.col("status") == "fail").alias("failed"))
    names = F.explode(F.array(*[F.lit(g) for g in required]))
    wanted = runs.withColumn("group", names).join(done, [by, "group"], "left")
    return wanted.select(by, "group", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
                         (F.col("sources").isNotNull() & (F.col("failed") == 0)).alias("covered"))


def missing_snapshots(jobs: DataFrame, stored: DataFrame) -> DataFrame:
    """Finished jobs whose snapshot is not in the store."""
    done = jobs.filter(F.col("status").isin("ok", "skip"))
    return done.join(stored.select("available_date", F.col("source").alias("source_id")), ["available_date", "source_id"], "left_anti")


def close_row_problem(symbol: Column, event_date: Column, close: Column) -> Column:
    """P10: why a live close row is refused, null when it is fine."""
    def blank(c):
        return F.trim(F.coalesce(c, F.lit(""))) == ""

    good = close.isNotNull() & ~F.isnan(close) & (F.abs(close) < float("inf")) & (close > 0)
    return (F.when(blank(symbol), "requires symbol").when(blank(event_date), "requires event_date")
            .when(~good, "requires positive close"))


def split_close_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P10: (accepted, quarantined with a reason)."""
    judged = rows.withColumn("problem", close_row_problem(F.col("symbol"), F.col("event_date"), F.col("close")))
    good = judged.filter("problem is null").select(F.trim("symbol").alias("symbol"), F.trim("event_date").alias("event_date"), "close")
    return good, judged.filter("problem is not null")


def latest_close_rows(jobs: DataFrame, records: DataFrame) -> DataFrame:
    """Per quote job the close of its payload's last line, or the reason there is none.

    (source_id, symbol, event_date, close, reason)
    """
    mine = jobs.filter(F.col("source_id").startswith("stooq:"))
    stored = records.select("available_date", F.col("source").alias("source_id"), "raw", F.col("event_date").alias("known"), F.lit(True).alias("found"))
    rows = mine.join(stored, ["available_date", "source_id"], "left")
    lines = F.filter(F.split("raw", "\r?\n"), lambda x: x != "")
    header = F.transform(F.split(F.get(lines, F.lit(0)), ","), lambda h: F.trim(h))
    cells = F.when(F.size(lines) > 1, F.split(F.element_at(lines, -1), ","))

    def cell(name):
        place = F.array_position(header, name).cast("int")
        return F.trim(F.when(place > 0, F.get(cells, place - 1)))

    close = cell("Close").try_cast("double")
    good = close.isNotNull() & ~F.isnan(close) & (F.abs(close) < float("inf")) & (close > 0)
    done = F.col("status").isin("ok", "skip")
    reason = (F.when(~done, F.concat(F.lit("status "), F.coalesce("status", F.lit("unknown")))).when(F.col("found").isNull(), "missing snapshot")
              .when(cells.isNull(), "no data rows").when(~good, "close must be positive"))
    known = F.when(F.trim(F.coalesce("known", F.lit(""))) != "", F.trim("known"))
    return rows.select("available_date", "source_id", F.substring_index("source_id", ":", -1).alias("symbol"),
                       F.when(reason.isNull(), F.coalesce(known, cell("Date"))).alias("event_date"),
                       F.when(reason.isNull(), close).alias("close"), reason.alias("reason"))


def schedule_observation(runs: DataFrame, by: str = "workflow") -> DataFrame:
    """The newest run of each category by (created_at, id); proven once a scheduled run succeeded."""
    row = F.struct("created_at", "id", "event", "status", "conclusion")
    scheduled, finished = F.col("event") == "schedule", F.col("status") == "completed"
    success = F.coalesce(F.col("conclusion") == "success", F.lit(False))

    def newest(condition):
        return F.max(F.when(condition, row))

    seen = runs.groupBy(by).agg(
        newest(scheduled & finished & success).alias("latest_schedule_success"), newest(scheduled).alias("latest_schedule_attempt"),
        newest(scheduled & finished & ~success).alias("latest_failed_schedule"),
        newest((F.col("event") == "workflow_dispatch") & finished & success).alias("latest_manual_success"),
        F.count("*").alias("observed_run_count"), F.count_if(scheduled).alias("schedule_run_count"))
    return seen.withColumn("status", F.when(F.col("latest_schedule_success").isNotNull(), "proven").otherwise("pending"))


def metric_drift(reference: DataFrame, current: DataFrame, threshold: float) -> DataFrame:
    """Experiments whose common metrics moved by more than the threshold.

    Both inputs are (experiment_id, metric, value); an experiment without a common
    metric is an error.
    """
    if threshold <= 0:
        raise ValueError("drift is measured against a threshold above zero")
    pairs = reference.withColumnRenamed("value", "before").join(current.withColumnRenamed("value", "now"), ["experiment_id", "metric"], "full")
    delta = F.col("now") - F.col("before")
    out = pairs.groupBy("experiment_id").agg(F.count(delta).alias("metrics"), F.max(F.abs(delta)).alias("largest"))
    void = F.when(F.col("metrics") == 0, F.raise_error(F.concat(F.lit("nothing to compare: no metric in common in "), F.col("experiment_id"))).cast("string"))
    return out.select("experiment_id", "metrics", "largest", F.coalesce(
        void, F.when(F.col("largest") > threshold, "drift_detected").otherwise("stable")).alias("status"))
