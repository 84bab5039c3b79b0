"""Point-in-time reads, filters, extents and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, calendars, pit
from . import base
from .base import D, MONTHLY, cte, day, query, r, rd, sql

AS_OF = "1999-06-30"
_AT = f"TIMESTAMP '{AS_OF}'"


@query("p1_availability_gate", sql("prices", f"""
    SELECT symbol, count(*) AS n, strftime(max(available_date), '%Y-%m-%d') AS newest FROM prices
    WHERE available_date <= {_AT} GROUP BY symbol"""))
def _(spark, d):
    return pit.available_at(base.prices(spark, d), AS_OF).groupBy("symbol").agg(
        F.count("*").alias("n"), day(F.max("available_date")).alias("newest"))


@query("p2_strict_pit", sql("prices", f"""
    SELECT symbol, count(*) AS n FROM prices WHERE NOT is_approximate AND available_date <= {_AT} GROUP BY symbol"""))
def _(spark, d):
    return pit.available_at(pit.strict_only(base.prices(spark, d)), AS_OF).groupBy("symbol").agg(F.count("*").alias("n"))


@query("p3_usable_prices", sql("prices", f"""
    SELECT symbol, count(*) AS n, {rd('min(close)')} AS low, {rd('max(close)')} AS high FROM prices
    WHERE NOT isnan(close) AND close > 0 AND close < CAST('inf' AS DOUBLE) GROUP BY symbol"""))
def _(spark, d):
    return pit.usable_prices(base.prices(spark, d)).groupBy("symbol").agg(
        F.count("*").alias("n"), r(F.min("close")).alias("low"), r(F.max("close")).alias("high"))


@query("p3_unusable_legs", sql("asof_px", f"""
    SELECT {D.format('as_of')} AS as_of, symbol, CASE WHEN isnan(close) THEN 'missing' ELSE 'not_positive' END AS reason
    FROM asof_px WHERE isnan(close) OR close <= 0"""))
def _(spark, d):
    cells = asof.latest_asof(base.prices(spark, d), MONTHLY)
    return cells.filter(~asof.usable(F.col("close"))).select(
        day("as_of").alias("as_of"), "symbol",
        F.when(F.isnan("close"), "missing").otherwise("not_positive").alias("reason"))


@query("p4_symbols", sql("prices", "SELECT DISTINCT symbol FROM prices ORDER BY symbol"))
def _(spark, d):
    return pit.symbols(base.prices(spark, d)).orderBy("symbol")


@query("p5_symbol_subset", sql("prices listings", """
    SELECT symbol, count(*) AS n FROM prices WHERE symbol IN (SELECT symbol FROM listings WHERE delist_date IS NOT NULL) GROUP BY symbol"""))
def _(spark, d):
    gone = base.listings(spark, d).filter("delist_date is not null")
    return pit.restrict(base.prices(spark, d), gone).groupBy("symbol").agg(F.count("*").alias("n"))


@query("p6_event_dates", sql("prices", f"""
    SELECT DISTINCT {D.format('event_date')} AS as_of FROM prices
    WHERE event_date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'"""))
def _(spark, d):
    dates = calendars.event_dates(base.prices(spark, d), "1996-01-01", "1999-12-31")
    return dates.select(day("as_of").alias("as_of"))


@query("p7_approximate_availability", sql("prices macro", f"""
    SELECT symbol AS name, count(*) AS n, {rd('max(close)')} AS top FROM prices WHERE event_date <= {_AT} AND NOT isnan(close) GROUP BY 1
    UNION ALL SELECT series, count(*), {rd('max(value)')} FROM macro WHERE event_date <= {_AT} GROUP BY 1"""))
def _(spark, d):
    px = pit.available_at(pit.approximate_availability(base.prices(spark, d)), AS_OF).filter(asof.present(F.col("close")))
    mx = pit.available_at(pit.approximate_availability(base.macro(spark, d)), AS_OF)
    rows = px.select(F.col("symbol").alias("name"), F.col("close").alias("v")).unionByName(
        mx.select(F.col("series").alias("name"), F.col("value").alias("v")))
    return rows.groupBy("name").agg(F.count("*").alias("n"), r(F.max("v")).alias("top"))


@query("p9_complete_dates", sql("index_hist", f"""
    SELECT {D.format('h.as_of')} AS as_of, {D.format('h.event_date')} AS event_date, {rd('sum(h.close)', 4)} AS total
    FROM index_hist h GROUP BY h.as_of, h.event_date HAVING count(DISTINCT symbol) = 5"""))
def _(spark, d):
    hist = asof.history_asof(base.index_prices(spark, d), MONTHLY)
    whole = asof.complete_dates(hist, base.ASSETS)
    return whole.groupBy("k", "event_date").agg(F.sum("close").alias("total")).select(
        day(MONTHLY.as_of(F.col("k"))).alias("as_of"), day("event_date").alias("event_date"), r("total", 4).alias("total"))


@query("j1_asof_latest", sql("asof_px", f"""
    SELECT {D.format('as_of')} AS as_of, symbol, {D.format('event_date')} AS event_date,
           {D.format('available_date')} AS available_date, CASE WHEN NOT isnan(close) THEN {rd('close')} END AS close FROM asof_px"""))
def _(spark, d):
    return asof.latest_asof(base.prices(spark, d), MONTHLY).select(
        day("as_of").alias("as_of"), "symbol", day("event_date").alias("event_date"), day("available_date").alias("available_date"),
        F.when(~F.isnan("close"), r("close")).alias("close"))


@query("j1_get_single_date", sql("prices", f"""
    SELECT symbol, {D.format('event_date')} AS event_date, {D.format('available_date')} AS available_date,
           CASE WHEN NOT isnan(close) THEN {rd('close')} END AS close FROM (
      SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY available_date DESC, event_date DESC, close DESC) AS rn
      FROM prices WHERE available_date <= {_AT}) WHERE rn = 1"""))
def _(spark, d):
    return pit.get(base.prices(spark, d), AS_OF).select(
        "symbol", day("event_date").alias("event_date"), day("available_date").alias("available_date"),
        F.when(~F.isnan("close"), r("close")).alias("close"))


@query("j1_event_replay_calendar", sql("prices", f"""
    SELECT {D.format('as_of')} AS as_of, symbol, {D.format('available_date')} AS available_date,
           CASE WHEN NOT isnan(close) THEN {rd('close')} END AS close FROM (
      SELECT c.as_of, p.*, row_number() OVER (PARTITION BY c.as_of, p.symbol ORDER BY p.available_date DESC, p.event_date DESC, p.close DESC) AS rn
      FROM (SELECT DISTINCT event_date AS as_of FROM prices WHERE event_date BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1999-12-31') c
      JOIN prices p ON p.available_date <= c.as_of) WHERE rn = 1"""))
def _(spark, d):
    rows = base.prices(spark, d)
    return asof.latest_over(rows, calendars.event_dates(rows, "1998-01-01", "1999-12-31")).select(
        day("as_of").alias("as_of"), "symbol", day("available_date").alias("available_date"),
        F.when(~F.isnan("close"), r("close")).alias("close"))


def event_quotes(spark, d):
    """Each event quotes its type for the hour it lies in; the quote is out 1 to 40 minutes later, or, revised, after two days."""
    late = F.when(F.col("event_id") % 9 == 0, 2880).otherwise(1 + F.col("event_id") % 40)
    events = base.table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "value", late.alias("late"))
    return events.select("symbol", F.expr("ts - make_dt_interval(0, 0, minute(ts), second(ts))").alias("event_date"),
                         F.expr("ts + make_dt_interval(0, 0, late)").alias("available_date"), F.col("value").alias("close"))


cte("event_quotes", """SELECT event_type AS symbol, ts - to_minutes(minute(ts)) - to_seconds(second(ts)) AS event_date,
      ts + to_minutes(CASE WHEN event_id % 9 = 0 THEN 2880 ELSE 1 + event_id % 40 END) AS available_date, value AS close FROM events""", [])
_MOMENT = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


def moment(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query("j1_intraday_replay", sql("event_quotes", f"""
    SELECT {_MOMENT.format('p.as_of')} AS as_of, p.symbol, {_MOMENT.format('q.available_date')} AS available_date, {_MOMENT.format('q.event_date')} AS event_date, {rd('q.close')} AS close
    FROM probes p ASOF JOIN newest q ON p.symbol = q.symbol AND p.as_of >= q.available_date""",
    newest="SELECT * FROM event_quotes QUALIFY row_number() OVER (PARTITION BY symbol, available_date ORDER BY event_date DESC, close DESC) = 1",
    probes="SELECT as_of, symbol FROM (SELECT DISTINCT ts AS as_of FROM events), (SELECT DISTINCT symbol FROM event_quotes)"))
def _(spark, d):
    moments = base.table(spark, d, "events").select(F.col("ts").cast("timestamp_ntz").alias("as_of"))
    return asof.latest_over(event_quotes(spark, d), moments).select(
        moment("as_of").alias("as_of"), "symbol", moment("available_date").alias("available_date"), moment("event_date").alias("event_date"), r("close").alias("close"))


@query("j2_asof_join_events", sql("event_quotes", f"""
    SELECT event_id, symbol, {_MOMENT.format('found.event_date')} AS event_date, {_MOMENT.format('found.available_date')} AS available_date, {rd('found.close')} AS close FROM (
      SELECT event_id, symbol, max(CASE WHEN event_id IS NULL THEN quote END) OVER (PARTITION BY symbol ORDER BY t RANGE UNBOUNDED PRECEDING) AS found FROM (
        SELECT NULL::BIGINT AS event_id, symbol, available_date AS t, {{'event_date': event_date, 'available_date': available_date, 'close': close}} AS quote FROM event_quotes
        UNION ALL SELECT event_id, event_type, ts, NULL FROM events)) WHERE event_id IS NOT NULL"""))
def _(spark, d):
    probes = base.table(spark, d, "events").select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("as_of"))
    return asof.asof_join(probes, event_quotes(spark, d), order=asof.BY_PERIOD).select(
        "event_id", "symbol", moment("event_date").alias("event_date"), moment("available_date").alias("available_date"), r("close").alias("close"))


@query("j2_macro_latest", sql("macro_asof", f"""
    SELECT {D.format('as_of')} AS as_of, series, {D.format('event_date')} AS event_date,
           {D.format('available_date')} AS available_date, {rd('value', 4)} AS value FROM macro_asof"""))
def _(spark, d):
    return asof.latest_asof(base.macro(spark, d), MONTHLY, "series", asof.BY_PERIOD, "value").select(
        day("as_of").alias("as_of"), "series", day("event_date").alias("event_date"), day("available_date").alias("available_date"),
        r("value", 4).alias("value"))


@query("j2_macro_single_date", sql("macro", f"""
    SELECT series, {rd('value', 4)} AS value FROM (
      SELECT *, row_number() OVER (PARTITION BY series ORDER BY event_date DESC, available_date DESC, value DESC) AS rn
      FROM macro WHERE available_date <= {_AT}) WHERE rn = 1"""))
def _(spark, d):
    return pit.macro(base.macro(spark, d), AS_OF).select("series", r("value", 4).alias("value"))


@query("j3_align_panel", sql("index_asof macro_asof", f"""
    SELECT {D.format('as_of')} AS as_of, symbol AS name, {rd('close', 4)} AS value FROM index_asof
    UNION ALL SELECT {D.format('as_of')}, series || '/macro', {rd('value', 4)} FROM macro_asof"""))
def _(spark, d):
    mx = base.macro(spark, d).withColumn("series", F.concat("series", F.lit("/macro")))
    panel = asof.align_panel(base.index_prices(spark, d), mx, MONTHLY)
    return panel.select(day("as_of").alias("as_of"), "name", r("value", 4).alias("value"))


@query("j3_align_wide", sql("index_asof macro_asof", f"""
    SELECT {D.format('c.as_of')} AS as_of, {rd("max(i.close) FILTER (WHERE i.symbol = '1-URGENT')", 4)} AS urgent,
           {rd("max(i.close) FILTER (WHERE i.symbol = '5-LOW')", 4)} AS low,
           {rd("max((SELECT value FROM macro_asof m WHERE m.k = c.k AND series = 'SPREAD'))", 4)} AS spread
    FROM cal c LEFT JOIN index_asof i ON i.k = c.k GROUP BY c.as_of"""))
def _(spark, d):
    panel = asof.align_panel(base.index_prices(spark, d), base.macro(spark, d).filter("series = 'SPREAD'"), MONTHLY)
    wide = asof.align_wide(panel, MONTHLY, ["1-URGENT", "5-LOW", "SPREAD"])
    return wide.select(day("as_of").alias("as_of"), r(F.col("1-URGENT"), 4).alias("urgent"),
                       r(F.col("5-LOW"), 4).alias("low"), r(F.col("SPREAD"), 4).alias("spread"))


@query("j4_history", sql("prices", f"""
    SELECT symbol, {D.format('event_date')} AS event_date, {D.format('available_date')} AS available_date,
           CASE WHEN NOT isnan(close) THEN {rd('close')} END AS close FROM (
      SELECT *, row_number() OVER (PARTITION BY symbol, event_date ORDER BY available_date DESC, close DESC) AS rn
      FROM prices WHERE available_date <= {_AT}) WHERE rn = 1"""))
def _(spark, d):
    return pit.history(base.prices(spark, d), AS_OF).select(
        "symbol", day("event_date").alias("event_date"), day("available_date").alias("available_date"),
        F.when(~F.isnan("close"), r("close")).alias("close"))


@query("j4_history_every_date", sql("hist", f"""
    SELECT {D.format('as_of')} AS as_of, symbol, count(*) AS n, {rd('sum(close)')} AS total FROM hist GROUP BY as_of, symbol"""))
def _(spark, d):
    hist = asof.history_asof(base.prices(spark, d), MONTHLY)
    return hist.groupBy("k", "symbol").agg(F.count("*").alias("n"), F.sum("close").alias("total")).select(
        day(MONTHLY.as_of(F.col("k"))).alias("as_of"), "symbol", "n", r("total").alias("total"))


@query("j5_universe", sql("cal listings", f"""
    SELECT {D.format('c.as_of')} AS as_of, symbol FROM cal c JOIN listings
    ON list_date <= c.as_of AND (delist_date IS NULL OR delist_date > c.as_of)"""))
def _(spark, d):
    return pit.universe(base.listings(spark, d), MONTHLY).select(day("as_of").alias("as_of"), "symbol")


@query("w9_last_rows", sql("hist", f"""
    SELECT {D.format('as_of')} AS as_of, symbol, {D.format('event_date')} AS event_date, {rd('close')} AS close FROM (
      SELECT *, row_number() OVER (PARTITION BY k, symbol ORDER BY event_date DESC) AS rn FROM hist) WHERE rn <= 3"""))
def _(spark, d):
    return asof.history_asof(base.prices(spark, d), MONTHLY, last=3).select(
        day(MONTHLY.as_of(F.col("k"))).alias("as_of"), "symbol", day("event_date").alias("event_date"), r("close").alias("close"))


@query("w10_latest_revision", sql("prices", f"""
    SELECT symbol, {D.format('event_date')} AS event_date, count(*) AS releases,
           CASE WHEN NOT isnan(arg_max(close, (available_date, close))) THEN {rd('arg_max(close, (available_date, close))')} END AS close
    FROM prices GROUP BY symbol, prices.event_date"""))
def _(spark, d):
    newest = F.max(F.struct("available_date", "close"))["close"]
    return base.prices(spark, d).groupBy("symbol", "event_date").agg(
        F.count("*").alias("releases"), newest.alias("close")).select(
        "symbol", day("event_date").alias("event_date"), "releases", F.when(~F.isnan("close"), r("close")).alias("close"))


@query("a4_derive_listings", sql("prices", f"""
    SELECT symbol, {D.format('min(event_date)')} AS list_date, CAST(NULL AS VARCHAR) AS delist_date FROM prices GROUP BY symbol"""))
def _(spark, d):
    return pit.derive_listings(base.prices(spark, d)).select(
        "symbol", day("list_date").alias("list_date"), day("delist_date").alias("delist_date"))


@query("a5_event_span", sql("prices", f"""
    SELECT {D.format('min(event_date)')} AS start, {D.format('max(event_date)')} AS "end" FROM prices"""))
def _(spark, d):
    return pit.event_span(base.prices(spark, d)).select(day("start").alias("start"), day("end").alias("end"))


@query("a6_asset_spans", sql("prices", f"""
    SELECT symbol, {D.format('min(event_date)')} AS start, {D.format('max(event_date)')} AS "end" FROM prices
    WHERE NOT isnan(close) AND close > 0 GROUP BY symbol"""))
def _(spark, d):
    return pit.asset_spans(base.prices(spark, d)).select("symbol", day("start").alias("start"), day("end").alias("end"))


def _order_extent(spark, d):
    return base.table(spark, d, "orders").agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end"))


_MONTH_ENDS = """
    SELECT last_day(CAST(m AS DATE)) AS d FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate))::TIMESTAMP,
           max(o_orderdate)::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM orders)"""


@query("f2_rebalance_calendar", sql("", f"""
    SELECT 'monthly' AS frequency, {D.format('d')} AS as_of FROM e
    UNION ALL SELECT 'quarterly', {D.format('d')} FROM q UNION ALL SELECT 'semiannual', {D.format('d')} FROM q WHERE rn % 2 = 1""",
    e=f"SELECT d FROM ({_MONTH_ENDS}) WHERE d BETWEEN (SELECT min(o_orderdate) FROM orders) AND (SELECT max(o_orderdate) FROM orders)",
    q="SELECT d, row_number() OVER (ORDER BY d) AS rn FROM e WHERE month(d) % 3 = 0"))
def _(spark, d):
    out = None
    for frequency in ("monthly", "quarterly", "semiannual"):
        ends = calendars.period_ends(_order_extent(spark, d), frequency).select(
            F.lit(frequency).alias("frequency"), day("as_of").alias("as_of"))
        out = ends if out is None else out.unionByName(ends)
    return out


@query("f5_business_days", """
    SELECT strftime(x, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(CAST(min(ts) AS DATE)::TIMESTAMP, CAST(max(ts) AS DATE)::TIMESTAMP, INTERVAL 1 DAY)) AS x FROM events)
    WHERE isodow(x) < 6""")
def _(spark, d):
    extent = base.table(spark, d, "events").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return calendars.business_days(extent).select(day("day").alias("day"))


@query("u1_union_of_sources", sql("prices index_prices macro", f"""
    SELECT kind, name, count(*) AS n, {D.format('min(event_date)')} AS first FROM (
      SELECT 'price' AS kind, symbol AS name, event_date FROM prices UNION ALL SELECT 'price', symbol, event_date FROM index_prices
      UNION ALL SELECT 'macro', series, event_date FROM macro) GROUP BY kind, name"""))
def _(spark, d):
    px = base.prices(spark, d).unionByName(base.index_prices(spark, d)).select(F.lit("price").alias("kind"), F.col("symbol").alias("name"), "event_date")
    mx = base.macro(spark, d).select(F.lit("macro").alias("kind"), F.col("series").alias("name"), "event_date")
    return px.unionByName(mx).groupBy("kind", "name").agg(F.count("*").alias("n"), day(F.min("event_date")).alias("first"))


@query("u3_common_dates", sql("prices index_prices", f"""
    SELECT {D.format('event_date')} AS event_date FROM (SELECT DISTINCT event_date FROM prices INTERSECT SELECT DISTINCT event_date FROM index_prices)"""))
def _(spark, d):
    both = base.prices(spark, d).select("event_date").intersect(base.index_prices(spark, d).select("event_date"))
    return both.select(day("event_date").alias("event_date"))


@query("u4_distinct_dates", sql("macro", f"SELECT DISTINCT {D.format('event_date')} AS event_date FROM macro ORDER BY 1"))
def _(spark, d):
    return base.macro(spark, d).select("event_date").distinct().orderBy("event_date").select(day("event_date").alias("event_date"))


_PLAN = calendars.WalkForward(36, 12, 12)


@query("j6_walk_forward", sql("", f"""
    SELECT CAST(f.fold AS BIGINT) AS fold, CASE WHEN x.d < f.split THEN 'in_sample' ELSE 'out_of_sample' END AS segment, {D.format('x.d')} AS as_of
    FROM folds f JOIN x ON x.d >= f.start AND x.d < f.split + INTERVAL 12 MONTH""",
    x=f"SELECT DISTINCT CAST(last_day(CAST(o_orderdate AS DATE)) AS TIMESTAMP) AS d FROM orders",
    walk="SELECT 0 AS fold, min(d) AS start FROM x UNION ALL SELECT fold + 1, start + INTERVAL 12 MONTH FROM walk WHERE fold < 100",
    folds="SELECT fold, start, start + INTERVAL 36 MONTH AS split FROM walk WHERE start + INTERVAL 36 MONTH <= (SELECT max(d) FROM x)"))
def _(spark, d):
    ends = base.table(spark, d, "orders").select(F.last_day("o_orderdate").cast("timestamp_ntz").alias("as_of")).distinct()
    members = calendars.fold_members(ends, _PLAN)
    return members.select(F.col("fold").cast("long").alias("fold"), "segment", day("as_of").alias("as_of"))


@query("u2_segment_dates", sql("", f"""
    SELECT DISTINCT CASE WHEN x.d < f.split THEN 'in_sample' ELSE 'out_of_sample' END AS segment, {D.format('x.d')} AS as_of
    FROM folds f JOIN x ON x.d >= f.start AND x.d < f.split + INTERVAL 12 MONTH""",
    x=f"SELECT DISTINCT CAST(last_day(CAST(o_orderdate AS DATE)) AS TIMESTAMP) AS d FROM orders",
    walk="SELECT 0 AS fold, min(d) AS start FROM x UNION ALL SELECT fold + 1, start + INTERVAL 12 MONTH FROM walk WHERE fold < 100",
    folds="SELECT fold, start, start + INTERVAL 36 MONTH AS split FROM walk WHERE start + INTERVAL 36 MONTH <= (SELECT max(d) FROM x)"))
def _(spark, d):
    ends = base.table(spark, d, "orders").select(F.last_day("o_orderdate").cast("timestamp_ntz").alias("as_of")).distinct()
    members = calendars.fold_members(ends, _PLAN)
    return members.select("segment", day("as_of").alias("as_of")).distinct()


@query("w8_every_nth_date", sql("prices", f"""
    SELECT frequency, {D.format('event_date')} AS as_of FROM (
      SELECT event_date, row_number() OVER (ORDER BY event_date) AS rn FROM (SELECT DISTINCT event_date FROM prices)),
      (VALUES ('monthly', 1), ('quarterly', 3), ('semiannual', 6)) AS f(frequency, step) WHERE rn % step = 0"""))
def _(spark, d):
    dates = base.prices(spark, d).select(F.col("event_date").alias("as_of")).distinct()
    parts = [calendars.every_nth(dates, f).select(F.lit(f).alias("frequency"), day("as_of").alias("as_of")) for f in calendars.DATE_STEP]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("w14_next_date", sql("prices", f"""
    SELECT {D.format('event_date')} AS as_of, {D.format('lead(event_date) OVER (ORDER BY event_date)')} AS next_as_of
    FROM (SELECT DISTINCT event_date FROM prices)"""))
def _(spark, d):
    dates = base.prices(spark, d).select(F.col("event_date").alias("as_of")).distinct()
    return calendars.next_dates(dates).select(day("as_of").alias("as_of"), day("next_as_of").alias("next_as_of"))
