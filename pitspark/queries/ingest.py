"""Payload parsing, record envelopes, the snapshot store and gap filling.

The payloads are built from the given tables in the feeds' own formats, then parsed
back; the SQL twins compute the parsed rows directly from the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import canonical_hash, file_safe, last_chart_date, last_csv_date, source_symbol, truthy
from ..schemas import CHART
from ..session import scratch_path
from ..sources import altdata, snapshots, vintage
from ..sources.runstore import registry_from_runs, experiment_id, new_experiments, ordered, register, read_registry, get_run, latest_runs, log_runs
from ..streaming import ingest
from . import base
from .base import D, METRIC_SQL, cte, day, query, r, rd, sql


def _text(rows, header):
    """(source, available_date, line...) to one payload per source and day; a payload spans a month of days."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("event_date", "line"))), lambda x: x["line"])
    body = F.array_join(F.concat(F.array(header), lines), "\n")
    return rows.groupBy("source", "available_date").agg(F.concat(body, F.lit("\n")).alias("raw"), F.max("event_date").alias("event_date"))


def observation_records(spark, d):
    """Daily mean order value per priority; one payload per priority and month, days with one order have no value."""
    daily = base.table(spark, d, "orders").groupBy("o_orderpriority", "o_orderdate").agg(
        F.count("*").alias("n"), F.max("o_totalprice").alias("v"))
    shown = F.when(F.col("n") == 1, ".").when(F.col("n") == 2, "").otherwise(F.col("v").cast("string"))
    rows = daily.select(F.concat(F.lit("fred:"), "o_orderpriority").alias("source"),
                        day(F.last_day("o_orderdate")).alias("available_date"), day("o_orderdate").alias("event_date"),
                        F.concat_ws(",", day("o_orderdate"), shown).alias("line"))
    return vintage.envelope(_text(rows, F.concat(F.lit("observation_date,"), source_symbol(F.first("source")))))


def quote_records(spark, d):
    """Each customer segment's largest order per day as quotes; the header order differs from the feed's."""
    orders, customer = base.table(spark, d, "orders"), base.table(spark, d, "customer")
    daily = orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy("c_mktsegment", "o_orderdate").agg(
        F.max("o_totalprice").alias("v"), F.count("*").alias("n"))
    close = F.when(F.col("n") == 1, "N/D").otherwise(F.col("v").cast("string"))
    rows = daily.select(F.concat(F.lit("stooq:"), F.lower("c_mktsegment")).alias("source"), day(F.last_day("o_orderdate")).alias("available_date"),
                        day("o_orderdate").alias("event_date"), F.concat_ws(",", day("o_orderdate"), "c_mktsegment", F.col("n").cast("string"), close).alias("line"))
    return vintage.envelope(_text(rows, F.lit("Date, Symbol ,Volume,Close")))


def chart_records(spark, d):
    """Largest event value per type and second of the day as chart JSON; small ones are null closes."""
    events = base.table(spark, d, "events")
    hour = F.to_date("ts").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour("ts"))
    rows = events.groupBy("event_type", hour.alias("t")).agg(F.max("value").alias("v"))
    rows = rows.select(F.concat(F.lit("yahoo:^"), "event_type").alias("source"), day("t").alias("available_date"), (F.datediff("t", F.lit("1970-01-01").cast("date")) * 86400 + F.hour("t") * 3600).cast("long").alias("t"),
                       F.when(F.col("v") >= 20, F.col("v")).alias("v"))
    points = rows.groupBy("source", "available_date").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("p"))
    closes = F.array_join(F.transform("p", lambda x: F.coalesce(x["v"].cast("string"), F.lit("null"))), ",")
    raw = F.concat(F.lit('{"chart":{"result":[{"timestamp":['), F.array_join("p.t", ","), F.lit('],"indicators":{"quote":[{"close":['),
                   closes, F.lit(']}]}}],"error":null}}'))
    return vintage.envelope(points.select("source", "available_date", raw.alias("raw"), F.lit(None).cast("string").alias("event_date")))


def all_records(spark, d):
    return observation_records(spark, d).unionByName(quote_records(spark, d)).unionByName(chart_records(spark, d))


cte("obs", """SELECT o_orderpriority AS series, o_orderdate AS event_date, last_day(CAST(o_orderdate AS DATE)) AS available_date, max(o_totalprice) AS value
    FROM orders GROUP BY 1, 2 HAVING count(*) > 2""", [])
cte("quotes", """SELECT c_mktsegment AS symbol, o_orderdate AS event_date, last_day(CAST(o_orderdate AS DATE)) AS available_date, max(o_totalprice) AS close
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 HAVING count(*) > 1""", [])
cte("charts", """SELECT '^' || event_type AS symbol, date_trunc('hour', ts) AS event_date, CAST(date_trunc('hour', ts) AS DATE) AS available_date, max(value) AS close
    FROM events GROUP BY 1, 2, 3 HAVING max(value) >= 20""", [])


@query("s1_observation_csv", sql("obs", f"SELECT series, {D.format('event_date')} AS event_date, {D.format('available_date')} AS available_date, {rd('value')} AS value FROM obs"))
def _(spark, d):
    return vintage.parse_observations(observation_records(spark, d)).select(
        "series", day("event_date").alias("event_date"), day("available_date").alias("available_date"), r("value").alias("value"))


@query("s2_quote_csv", sql("quotes", f"SELECT symbol, {D.format('event_date')} AS event_date, {D.format('available_date')} AS available_date, {rd('close')} AS close FROM quotes"))
def _(spark, d):
    return vintage.parse_quotes(quote_records(spark, d)).select(
        "symbol", day("event_date").alias("event_date"), day("available_date").alias("available_date"), r("close").alias("close"))


@query("s3_chart_json", sql("charts", f"SELECT symbol, strftime(event_date, '%Y-%m-%d %H') AS event_hour, {D.format('available_date')} AS available_date, {rd('close')} AS close FROM charts"))
def _(spark, d):
    return vintage.parse_charts(chart_records(spark, d)).select(
        "symbol", F.date_format("event_date", "yyyy-MM-dd HH").alias("event_hour"), day("available_date").alias("available_date"), r("close").alias("close"))


@query("s4_vintage_loader", sql("obs quotes charts", f"""
    SELECT 'prices' AS kind, symbol AS name, count(*) AS n, {rd('max(close)')} AS top FROM (SELECT symbol, close FROM quotes UNION ALL SELECT symbol, close FROM charts
      UNION ALL SELECT series, value FROM obs WHERE series = '1-URGENT') GROUP BY symbol
    UNION ALL SELECT 'macro', series, count(*), {rd('max(value)')} FROM obs WHERE series <> '1-URGENT' GROUP BY series"""))
def _(spark, d):
    path = scratch_path(spark, "snapshots")
    # landed as JSON records in day folders, then read back recursively
    all_records(spark, d).withColumn("day", F.col("available_date")).write.partitionBy("day").json(path)
    px, mx, _ = vintage.load_panel(vintage.read_snapshots(spark, path, one_per_file=False), {"1-URGENT"})
    rows = px.select(F.lit("prices").alias("kind"), F.col("symbol").alias("name"), F.col("close").alias("v")).unionByName(
        mx.select(F.lit("macro").alias("kind"), F.col("series").alias("name"), F.col("value").alias("v")))
    return rows.groupBy("kind", "name").agg(F.count("*").alias("n"), r(F.max("v")).alias("top"))



def alt_rows(spark, d):
    events = base.table(spark, d, "events")
    return events.select(
        F.col("event_type").alias("source"), F.lit("events").alias("dataset"), day("ts").alias("event_date"),
        day(F.col("ts") + F.expr("interval 2 days")).alias("available_date"), "value",
        F.when(F.col("user_id") < 50, " TRUE ").when(F.col("user_id") < 75, "yes").when(F.col("user_id") < 100, "no").otherwise("").alias("is_approximate"))


def alt_contracts(spark):
    rows = [(s, "events", "https://example.test/" + s, "v1", False, "available", altdata.BOUNDARY) for s in ("view", "purchase", "click", "error", "signup")]
    from ..schemas import ALT_CONTRACT
    return spark.createDataFrame(rows, ALT_CONTRACT)


cte("alt", """SELECT event_type AS source, strftime(ts, '%Y-%m-%d') AS event_date, strftime(ts + INTERVAL 2 DAY, '%Y-%m-%d') AS available_date, value, user_id < 75 AS is_approximate
    FROM events WHERE strftime(ts + INTERVAL 2 DAY, '%Y-%m-%d') <= '2024-01-20'""", [])


@query("s5_alt_data_csv", sql("alt", f"""
    SELECT event_date, available_date, is_approximate, count(*) AS n, {rd('sum(value)', 4)} AS total FROM alt WHERE source = 'view' GROUP BY ALL"""))
def _(spark, d):
    path = scratch_path(spark, "alt")
    alt_rows(spark, d).filter("source = 'view'").select("event_date", "available_date", "value", "is_approximate").write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    rows = altdata.read_csv(spark, path, ("view", "events"), alt_contracts(spark), "2024-01-20")
    return rows.groupBy("event_date", "available_date", "is_approximate").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@query("s6_alt_data_bundle", sql("alt", f"""
    SELECT source, event_date, is_approximate, count(*) AS n, {rd('sum(value)', 4)} AS total FROM alt GROUP BY source, event_date, is_approximate"""))
def _(spark, d):
    path = scratch_path(spark, "alt")
    alt_rows(spark, d).select("source", "event_date", "available_date", "value", "is_approximate").write.partitionBy("source").option("header", True).csv(path)
    files = {(s, "events"): f"{path}/source={s}" for s in ("view", "purchase", "click", "error", "signup")}
    rows = altdata.read_bundle(spark, files, alt_contracts(spark), "2024-01-20")
    return rows.groupBy("source", "event_date", "is_approximate").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@query("j15_contract_join", sql("alt", "SELECT source, count(*) AS n, 'source_contract_status_only' AS claim_boundary FROM alt GROUP BY source"))
def _(spark, d):
    return altdata.observations(alt_rows(spark, d), alt_contracts(spark), "2024-01-20").groupBy("source").agg(
        F.count("*").alias("n"), F.max("claim_boundary").alias("claim_boundary"))


@query("s7_immutable_store", sql("obs quotes charts", """
    SELECT source, count(*) AS records FROM (SELECT DISTINCT 'fred:' || o_orderpriority AS source, last_day(CAST(o_orderdate AS DATE)) AS a FROM orders
      UNION ALL SELECT DISTINCT 'stooq:' || lower(c_mktsegment), last_day(CAST(o_orderdate AS DATE)) FROM orders JOIN customer ON o_custkey = c_custkey
      UNION ALL SELECT DISTINCT 'yahoo:^' || event_type, CAST(ts AS DATE) FROM events) GROUP BY source"""))
def _(spark, d):
    path = scratch_path(spark, "store")
    snapshots.write_snapshots(observation_records(spark, d), path)
    # the second write brings the first sources again with other payloads: they must not get in
    again = all_records(spark, d).withColumn("raw", F.when(F.col("source").startswith("fred:"), "changed").otherwise(F.col("raw")))
    snapshots.write_snapshots(again, path)
    stored = snapshots.read_store(spark, path)
    return stored.filter("raw <> 'changed'").groupBy("source").agg(F.count("*").alias("records"))


@query("s8_record_envelope", sql("obs", """
    SELECT source, count(*) AS n, TRUE AS is_approximate, TRUE AS gap_fill, '1995-01-01' AS gap_window_since
    FROM (SELECT DISTINCT 'fred:' || o_orderpriority AS source, last_day(CAST(o_orderdate AS DATE)) AS a FROM orders) GROUP BY source"""))
def _(spark, d):
    payloads = observation_records(spark, d).select("source", "available_date", "raw", "event_date")
    stamped = vintage.envelope(payloads, "gap_fill", window_since="1995-01-01")
    return stamped.groupBy("source", "is_approximate", "gap_fill", "gap_window_since").agg(F.count("*").alias("n"))


@query("s16_backfill_manifest", """
    SELECT strftime(ts, '%Y-%m-%d') AS run, count(*) FILTER (WHERE user_id % 10 < 6) AS ok, count(*) FILTER (WHERE user_id % 10 BETWEEN 6 AND 7) AS skip,
      count(*) FILTER (WHERE user_id % 10 > 7) AS fail, count(*) AS sources FROM events GROUP BY 1""")
def _(spark, d):
    tail = F.col("user_id") % 10
    status = F.when(tail < 6, "ok").when(tail < 8, "skip").otherwise("fail:TimeoutError")
    results = base.table(spark, d, "events").select(day("ts").alias("run"), F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("source"), status.alias("status"))
    return snapshots.manifest(results).select("run", "ok", "skip", "fail", "sources")


@query("f6_source_ids", "SELECT DISTINCT 'yahoo_idx_' || event_type AS file_id, '^' || event_type AS symbol FROM events")
def _(spark, d):
    source = base.table(spark, d, "events").select(F.concat(F.lit("yahoo:^"), "event_type").alias("s")).distinct()
    return source.select(file_safe(F.col("s")).alias("file_id"), source_symbol(F.col("s")).alias("symbol"))


@query("f7_boolean_text", "SELECT source, lower(trim(lang)) IN ('1', 'true', 'yes', 'y') OR n_chars > 500 AS flag, count(*) AS n FROM documents GROUP BY 1, 2")
def _(spark, d):
    text = F.when(F.col("n_chars") > 500, F.lit(" Yes")).otherwise(F.col("lang"))
    return base.table(spark, d, "documents").select("source", truthy(text).alias("flag")).groupBy("source", "flag").agg(F.count("*").alias("n"))


@query("f8_last_event_date", sql("charts", f"""
    SELECT 'fred:' || o_orderpriority AS source, {D.format('last_day(CAST(o_orderdate AS DATE))')} AS available_date, {D.format('max(o_orderdate)')} AS last_event FROM orders GROUP BY 1, 2
    UNION ALL SELECT 'yahoo:' || symbol, {D.format('available_date')}, {D.format('max(event_date)')} FROM charts GROUP BY 1, 2"""))
def _(spark, d):
    text = observation_records(spark, d).select("source", "available_date", last_csv_date(F.col("raw")).alias("last_event"))
    chart = chart_records(spark, d).select("source", "available_date", last_chart_date(F.col("raw"), CHART).alias("last_event"))
    return text.unionByName(chart.filter("last_event is not null"))


@query("f9_canonical_hash", """
    SELECT p_partkey AS id, sha256('{"a_brand":"' || p_brand || '","b_size":' || p_size || '}') AS digest FROM part""")
def _(spark, d):
    return base.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), canonical_hash(F.struct(F.col("p_brand").alias("a_brand"), F.col("p_size").alias("b_size"))).alias("digest"))


# -- gaps ---------------------------------------------------------------------

_SINCE = "2024-01-03"
cte("gapdays", """SELECT d FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6
    AND CAST(d AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING max(value) > 160)""", [])
cte("gapobs", """SELECT 'fred:' || event_type AS source, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS event_date, max(value) AS value FROM events GROUP BY 1, 2""", [])


def gap_days(spark, d):
    captured = (base.table(spark, d, "events").filter("event_type = 'purchase'").groupBy(F.to_date("ts").alias("day"))
                .agg(F.max("value").alias("v")).filter("v > 160"))
    span = spark.createDataFrame([("2024-01-08", "2024-01-31")], "start string, end string")
    return ingest.missing_days(span, captured)


def gap_observations(spark, d):
    return (base.table(spark, d, "events").groupBy(F.concat(F.lit("fred:"), "event_type").alias("source"), F.to_date("ts").cast("timestamp_ntz").alias("event_date"))
            .agg(F.max("value").alias("value"), F.max("ts").alias("available_date")))


@query("p8_gap_slices", sql("gapdays gapobs", f"""
    SELECT {D.format('d')} AS day, source, count(*) AS n, {D.format('max(event_date)')} AS last_event FROM gapdays JOIN gapobs ON event_date BETWEEN TIMESTAMP '{_SINCE}' AND d GROUP BY d, source"""))
def _(spark, d):
    slices = vintage.gap_slices(gap_observations(spark, d), gap_days(spark, d), _SINCE)
    return slices.select(day("day").alias("day"), "source", F.size("rows").cast("long").alias("n"), day("last_event").alias("last_event"))


@query("t4_gap_fill", sql("gapdays gapobs", f"""
    SELECT {D.format('d')} AS available_date, source, {D.format('event_date')} AS event_date, {rd('value')} AS value, TRUE AS is_approximate
    FROM gapdays JOIN gapobs ON event_date BETWEEN TIMESTAMP '{_SINCE}' AND d"""))
def _(spark, d):
    path = scratch_path(spark, "store")
    ingest.fill_gaps(gap_observations(spark, d), gap_days(spark, d), _SINCE, path)
    rows = vintage.parse_observations(snapshots.read_store(spark, path))
    return rows.select(day("available_date").alias("available_date"), F.concat(F.lit("fred:"), "series").alias("source"), day("event_date").alias("event_date"),
                       r("value").alias("value"), "is_approximate")


# -- streams over the landed files --------------------------------------------

@query("t1_stream_ingest", sql("", f"""
    SELECT 'event:' || event_type AS source, strftime(ts, '%Y-%m-%d') AS available_date, count(*) AS candidates, min(event_id) AS first_id FROM events GROUP BY 1, 2"""))
def _(spark, d):
    # every event asks to be the snapshot of its type and day; the first capture wins
    stored = ingest.run_event_ingest(spark, d)
    counts = base.table(spark, d, "events").groupBy(F.concat(F.lit("event:"), "event_type").alias("source"), day("ts").alias("available_date")).agg(F.count("*").alias("candidates"))
    first = stored.select("source", "available_date", F.get_json_object("raw", "$.id").cast("long").alias("first_id"))
    return counts.join(first, ["source", "available_date"])


@query("t2_bad_source_isolation", sql("", """
    SELECT CASE WHEN value >= 1 THEN 'good' ELSE 'quarantine' END AS sink, event_type, count(*) AS n FROM events GROUP BY 1, 2"""))
def _(spark, d):
    good, bad = ingest.run_quarantine(spark, d)
    both = good.select(F.lit("good").alias("sink"), "event_type").unionByName(bad.select(F.lit("quarantine").alias("sink"), "event_type"))
    return both.groupBy("sink", "event_type").agg(F.count("*").alias("n"))


@query("t3_latest_revision_stream", sql("prices", f"""
    SELECT symbol, {D.format('event_date')} AS event_date, CASE WHEN NOT isnan(c) THEN {rd('c')} END AS close FROM (
      SELECT symbol, event_date, arg_max(close, (available_date, close)) AS c FROM prices GROUP BY symbol, event_date)"""))
def _(spark, d):
    rows = ingest.run_latest_revisions(spark, d)
    return rows.select("symbol", day("event_date").alias("event_date"), F.when(~F.isnan("close"), r("close")).alias("close"))


# -- run and experiment tables ------------------------------------------------

from .research import _FOUR, four_runs  # noqa: E402


@query("s9_run_upsert", sql("wi_all index_legs seg", f"""
    SELECT run AS run_id, CASE WHEN run = 'static' THEN 'renamed' ELSE run END AS strategy_name, {rd('sharpe')} AS oos_net_sharpe FROM metric WHERE segment = 'out_of_sample'""", **_FOUR))
def _(spark, d):
    path = scratch_path(spark, "runs")
    records = four_runs(spark, d)
    log_runs(records, path)
    log_runs(records.filter("run_id = 'static'").withColumn("strategy_name", F.lit("renamed")), path)
    return latest_runs(spark.read.parquet(path)).select("run_id", "strategy_name", r("oos_net_sharpe").alias("oos_net_sharpe"))


@query("s10_run_lookup", sql("wi_all index_legs seg", f"""
    SELECT run AS run_id, {rd('sharpe')} AS oos_net_sharpe FROM metric WHERE segment = 'out_of_sample' AND run = 'random'""", **_FOUR))
def _(spark, d):
    path = scratch_path(spark, "runs")
    log_runs(four_runs(spark, d), path)
    return get_run(latest_runs(spark.read.parquet(path)), "random").select("run_id", r("oos_net_sharpe").alias("oos_net_sharpe"))


def experiments(spark, d):
    """One experiment per brand and size found among the parts."""
    part = base.table(spark, d, "part").select("p_brand", "p_type", "p_size").distinct()
    return part.select(
        F.col("p_type").alias("model_family"), F.col("p_brand").alias("strategy_name"), F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("config"),
        F.array(F.lit("r1")).alias("run_ids"), F.create_map(F.lit("sharpe"), F.lit(1.0)).alias("metrics"), F.lit("no_alpha_claim").alias("claim_boundary"),
        F.array(F.lit("grid")).alias("tags"))


_EXP = """SELECT DISTINCT p_type AS model_family, p_brand AS strategy_name, CAST(p_size AS VARCHAR) AS size,
    substr(sha256('{"config":{"size":"' || p_size || '"},"model_family":"' || p_type || '","strategy_name":"' || p_brand || '"}'), 1, 16) AS experiment_id FROM part"""


@query("s11_register_experiments", _EXP)
def _(spark, d):
    path = scratch_path(spark, "registry")
    register(experiments(spark, d), path)
    register(experiments(spark, d), path)
    return read_registry(spark, path).select("model_family", "strategy_name", F.col("config")["size"].alias("size"), "experiment_id")


@query("s12_registry_scan", f"SELECT model_family, count(*) AS n, min(experiment_id) AS first_id FROM ({_EXP}) GROUP BY model_family")
def _(spark, d):
    path = scratch_path(spark, "registry")
    register(experiments(spark, d), path)
    return read_registry(spark, path).groupBy("model_family").agg(F.count("*").alias("n"), F.min("experiment_id").alias("first_id"))


@query("o4_experiment_order", f"SELECT model_family, strategy_name, experiment_id FROM ({_EXP}) ORDER BY 1, 2, 3")
def _(spark, d):
    from ..schemas import EXPERIMENT
    fresh = new_experiments(experiments(spark, d), spark.createDataFrame([], EXPERIMENT))
    return ordered(fresh).select("model_family", "strategy_name", "experiment_id")


@query("s13_registry_from_runs", sql("wi_all index_legs seg", f"""
    SELECT 'timing' AS model_family, {rd('sharpe')} AS sharpe, {rd('max_drawdown')} AS max_drawdown, 2 AS runs FROM metric WHERE segment = 'out_of_sample' AND run = 'sma_timing'""", **_FOUR))
def _(spark, d):
    wanted = spark.createDataFrame([("timing", "sma", {"window": "6"}, ["sma_timing", "random"], ["t"])],
                                   "model_family string, strategy_name string, config map<string,string>, run_ids array<string>, tags array<string>")
    return registry_from_runs(four_runs(spark, d), wanted).select(
        "model_family", r(F.col("metrics")["sharpe"]).alias("sharpe"), r(F.col("metrics")["max_drawdown"]).alias("max_drawdown"), F.size("run_ids").alias("runs"))
