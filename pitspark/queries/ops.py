"""Source health, snapshot gates, quorum, drift and report files over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality
from ..operators import ladder as ladders
from ..plans import reports
from ..session import scratch_path
from ..sources import reports as files
from . import base
from .base import backtest_blocks, day, query, r, rd, sql
from .ingest import quote_records
from .ladders import _PLANS, _ladder, plans
from .returns import CONFIG, index_weights

GROUPS = {"browse": ["web:view", "web:click"], "commerce": ["web:purchase"], "accounts": ["web:signup", "web:login"]}
_STATUS = "CASE WHEN value < 2 THEN 'fail' WHEN value < 20 THEN 'skip' WHEN value < 100 THEN 'ok' ELSE 'dry' END"


def jobs(spark, d):
    """Each event is a job of its user's run; its value decides the outcome."""
    v = F.col("value")
    status = F.when(v < 2, "fail").when(v < 20, "skip").when(v < 100, "ok").otherwise("dry")
    return base.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("run"), F.concat(F.lit("web:"), "event_type").alias("source_id"), status.alias("status"),
        day("ts").alias("available_date"))


@query("a15_source_health", """
    WITH e AS (SELECT event_type AS source, CAST(user_id AS VARCHAR) AS symbol, event_id AS seq, CASE WHEN value > 50 THEN 'available' ELSE 'degraded' END AS status FROM events)
    SELECT source, arg_max(status, seq) AS status, count(*) AS records, count(DISTINCT symbol) AS symbols, arg_min(symbol, seq) AS first_symbol FROM e GROUP BY source""")
def _(spark, d):
    records = base.table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.upper("event_type").alias("source"), F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("symbol"),
        F.when(F.col("value") > 50, "available").otherwise("degraded").alias("status"), F.lit(True).alias("default_enabled"), F.lit("").alias("reason"))
    return quality.source_health(records).select("source", "status", "records", "symbols", "first_symbol")


@query("a16_snapshot_gate", f"""
    SELECT run, ok, skip, fail, dry, jobs, CASE WHEN fail > 0 AND allow = 'strict' THEN 'failed_sources' WHEN ok + skip + dry = 0 THEN 'no_work' WHEN fail > 0 THEN 'partial' ELSE 'clean' END AS verdict, allow
    FROM (SELECT CAST(user_id AS VARCHAR) AS run, count(*) FILTER (WHERE s = 'ok') AS ok, count(*) FILTER (WHERE s = 'skip') AS skip, count(*) FILTER (WHERE s = 'fail') AS fail,
      count(*) FILTER (WHERE s = 'dry') AS dry, count(*) AS jobs FROM (SELECT *, {_STATUS} AS s FROM events) GROUP BY 1), (VALUES ('strict'), ('lenient')) AS a(allow)""")
def _(spark, d):
    table = jobs(spark, d)
    strict = quality.snapshot_gate(table, quality.job_counts(table)).withColumn("allow", F.lit("strict"))
    lenient = quality.snapshot_gate(table, allow_failures=True).withColumn("allow", F.lit("lenient"))
    return strict.unionByName(lenient)


@query("j18_source_quorum", f"""
    WITH j AS (SELECT CAST(user_id AS VARCHAR) AS run, 'web:' || event_type AS source_id, {_STATUS} AS status FROM events),
    g AS (SELECT * FROM (VALUES ('browse', 'web:view'), ('browse', 'web:click'), ('commerce', 'web:purchase'), ('accounts', 'web:signup'), ('accounts', 'web:login')) AS t("group", source_id)),
    runs AS (SELECT run, count(*) FILTER (WHERE status = 'fail') AS failed FROM j GROUP BY run)
    SELECT run, "group", coalesce(sources, '') AS sources, sources IS NOT NULL AND failed = 0 AS covered FROM runs CROSS JOIN (SELECT DISTINCT "group" FROM g) x
    LEFT JOIN (SELECT run, "group", string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS sources FROM j JOIN g USING (source_id) WHERE status IN ('ok', 'skip') GROUP BY ALL) USING (run, "group")""")
def _(spark, d):
    out = quality.source_quorum(jobs(spark, d), GROUPS)
    return out.select("run", "group", F.array_join("sources", ",").alias("sources"), "covered")


@query("j19_missing_snapshots", f"""
    SELECT available_date, source_id, count(*) AS n FROM (SELECT strftime(ts, '%Y-%m-%d') AS available_date, 'web:' || event_type AS source_id, {_STATUS} AS status FROM events) j
    WHERE status IN ('ok', 'skip') AND (available_date, source_id) NOT IN (SELECT (strftime(ts, '%Y-%m-%d'), 'web:' || event_type) FROM events WHERE value > 250) GROUP BY 1, 2""")
def _(spark, d):
    stored = base.table(spark, d, "events").filter("value > 250").select(day("ts").alias("available_date"), F.concat(F.lit("web:"), "event_type").alias("source")).distinct()
    return quality.missing_snapshots(jobs(spark, d), stored).groupBy("available_date", "source_id").agg(F.count("*").alias("n"))


@query("p10_live_close_rows", sql("prices", """
    SELECT CASE WHEN isnan(close) OR close <= 0 THEN 'requires positive close' ELSE 'accepted' END AS outcome, symbol, count(*) AS n FROM prices GROUP BY 1, 2"""))
def _(spark, d):
    rows = base.prices(spark, d).withColumn("event_date", day("event_date"))
    good, bad = quality.split_close_rows(rows)
    both = good.select(F.lit("accepted").alias("outcome"), "symbol").unionByName(bad.select(F.col("problem").alias("outcome"), "symbol"))
    return both.groupBy("outcome", "symbol").agg(F.count("*").alias("n"))


@query("p11_latest_close_row", f"""
    WITH q AS (SELECT 'stooq:' || lower(c_mktsegment) AS source_id, strftime(last_day(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS available_date, o_orderdate AS d, count(*) AS n, max(o_totalprice) AS v
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    l AS (SELECT source_id, available_date, arg_max(n, d) AS n, arg_max(v, d) AS v, max(d) AS d FROM q GROUP BY 1, 2)
    SELECT available_date, source_id, CASE WHEN n > 1 THEN strftime(d, '%Y-%m-%d') END AS event_date, CASE WHEN n > 1 THEN {rd('v')} END AS close,
      CASE WHEN n = 1 THEN 'close must be positive' END AS reason FROM l""")
def _(spark, d):
    records = quote_records(spark, d)
    todo = records.select("available_date", F.col("source").alias("source_id"), F.lit("ok").alias("status"))
    return quality.latest_close_rows(todo, records).select("available_date", "source_id", "event_date", r("close").alias("close"), "reason")


_RUNS = """SELECT CAST(user_id AS VARCHAR) AS workflow, event_id AS id, ts AS created_at, CASE WHEN event_type IN ('view', 'click') THEN 'schedule' ELSE 'workflow_dispatch' END AS event,
    CASE WHEN value < 10 THEN 'in_progress' ELSE 'completed' END AS status, CASE WHEN value < 10 THEN NULL WHEN value < 120 THEN 'failure' ELSE 'success' END AS conclusion FROM events"""


@query("a21_schedule_observation", f"""
    WITH r AS ({_RUNS}) SELECT workflow, CAST(arg_max(id, (created_at, id)) FILTER (WHERE event = 'schedule' AND conclusion = 'success') AS VARCHAR) AS success,
      CAST(arg_max(id, (created_at, id)) FILTER (WHERE event = 'schedule') AS VARCHAR) AS attempt, CAST(arg_max(id, (created_at, id)) FILTER (WHERE event = 'schedule' AND conclusion = 'failure') AS VARCHAR) AS failed,
      CAST(arg_max(id, (created_at, id)) FILTER (WHERE event <> 'schedule' AND conclusion = 'success') AS VARCHAR) AS manual, count(*) AS runs, count(*) FILTER (WHERE event = 'schedule') AS scheduled,
      CASE WHEN bool_or(event = 'schedule' AND coalesce(conclusion, '') = 'success') THEN 'proven' ELSE 'pending' END AS status FROM r GROUP BY workflow""")
def _(spark, d):
    v = F.col("value")
    table = base.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("workflow"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"),
        F.when(F.col("event_type").isin("view", "click"), "schedule").otherwise("workflow_dispatch").alias("event"),
        F.when(v < 10, "in_progress").otherwise("completed").alias("status"), F.when(v < 10, None).when(v < 120, "failure").otherwise("success").alias("conclusion"))
    out = quality.schedule_observation(table)
    return out.select("workflow", F.col("latest_schedule_success.id").cast("string").alias("success"), F.col("latest_schedule_attempt.id").cast("string").alias("attempt"),
                      F.col("latest_failed_schedule.id").cast("string").alias("failed"), F.col("latest_manual_success.id").cast("string").alias("manual"),
                      F.col("observed_run_count").alias("runs"), F.col("schedule_run_count").alias("scheduled"), "status")


@query("j17_metric_drift", f"""
    WITH m AS (SELECT CAST(user_id AS VARCHAR) AS experiment_id, event_type AS metric, avg(value) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS b, avg(value) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS n FROM events GROUP BY 1, 2)
    SELECT experiment_id, count(n - b) AS metrics, {rd('max(abs(n - b))')} AS largest, CASE WHEN max(abs(n - b)) > 40 THEN 'drift_detected' ELSE 'stable' END AS status FROM m GROUP BY 1 HAVING count(n - b) > 0""")
def _(spark, d):
    events = base.table(spark, d, "events")

    def half(condition):
        return events.filter(condition).groupBy(F.col("user_id").cast("string").alias("experiment_id"), F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))

    before, now = half("ts < timestamp_ntz'2024-01-16'"), half("ts >= timestamp_ntz'2024-01-16'")
    common = before.join(now, ["experiment_id", "metric"], "left_semi").select("experiment_id").distinct()
    keep = before.join(common, "experiment_id", "left_semi"), now.join(common, "experiment_id", "left_semi")
    return quality.metric_drift(*keep, 40.0).select("experiment_id", "metrics", r("largest").alias("largest"), "status")


@query("s14_report_files", sql("wi_all index_legs seg", f"""
    SELECT 'computed' AS status, run AS strategy_name, {rd('sharpe')} AS oos_net_sharpe FROM metric WHERE segment = 'out_of_sample'""", **backtest_blocks("wi_all", "index_legs", 45)))
def _(spark, d):
    path = scratch_path(spark, "report")
    files.write_report(reports.oos_report(base.index_prices(spark, d), index_weights(spark, d), CONFIG, baselines=["equal_weight"]), path)
    back = spark.read.schema("status string, strategy_name string, oos_net_sharpe double").json(path)
    return back.select("status", "strategy_name", r("oos_net_sharpe").alias("oos_net_sharpe"))


@query("s15_ladder_files", _PLANS + _ladder("a") + f"""SELECT plan, count(*) AS levels, {rd('sum(amount)', 4)} AS total FROM w GROUP BY plan""")
def _(spark, d):
    path, table = scratch_path(spark, "ladders"), plans(spark, d)
    levels = ladders.ladder(table)
    files.write_ladders(levels, ladders.totals(levels, table), path)
    back = spark.read.option("header", True).schema("plan bigint, level int, price double, units double, amount double, a double, b double, c double, e double").csv(f"{path}/levels")
    return back.groupBy("plan").agg(F.count("*").alias("levels"), r(F.sum("amount"), 4).alias("total"))
