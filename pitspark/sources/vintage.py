"""Snapshot records: one payload per (source, day), parsed into prices and macro series.

Record layout and payload formats follow the public feeds: CSV text with one
observation per line, CSV quotes with a header, and nested chart JSON.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import source_symbol
from ..operators.pit import approximate_availability, derive_listings, strict_only
from ..schemas import CHART, MACRO, PRICES, SNAPSHOT


def read_snapshots(spark: SparkSession, root: str, one_per_file: bool = True) -> DataFrame:
    """Every JSON record under a folder, whatever the nesting.

    A landed file holds one pretty-printed record; files with a record per line are
    splittable and read with ``one_per_file`` off.
    """
    return (spark.read.schema(SNAPSHOT).option("multiLine", one_per_file).option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.json").json(root))


def usable_records(records: DataFrame) -> DataFrame:
    """Records without an available date or a text payload are skipped."""
    return records.filter((F.coalesce("available_date", F.lit("")) != "") & F.col("raw").isNotNull())


def _kind(records: DataFrame, prefix: str) -> DataFrame:
    return records.filter(F.col("source").startswith(prefix + ":"))


def _lines(raw: Column) -> Column:
    return F.split(raw, "\r?\n")


def _cells(line: Column) -> Column:
    """Split on the commas outside quotes."""
    return F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)')


def _unquote(cell: Column) -> Column:
    """A CSV cell without its quotes."""
    return F.regexp_replace(cell, '^"(.*)"$', "$1")


def _flag() -> Column:
    return F.coalesce("is_approximate", F.lit(False)).alias("is_approximate")


def parse_observations(records: DataFrame) -> DataFrame:
    """(series, event_date, available_date, value, is_approximate) from observation CSV.

    The first line is the header; short lines, empty or dotted values and anything
    that is not a number are dropped.
    """
    lines = _kind(records, "fred").select(
        source_symbol(F.col("source")).alias("series"), F.col("available_date"), _flag(), F.posexplode(_lines(F.col("raw"))).alias("pos", "line"))
    cells = lines.filter("pos > 0").withColumn("cells", _cells(F.col("line")))
    value = _unquote(F.get("cells", F.lit(1)))
    rows = cells.select("series", _unquote(F.get("cells", F.lit(0))).try_cast("timestamp_ntz").alias("event_date"),
                        F.col("available_date").try_cast("timestamp_ntz").alias("available_date"),
                        F.when(~value.isin("", "."), value.try_cast("double")).alias("value"), "is_approximate")
    return rows.filter("value is not null").select(*MACRO.fieldNames())


def parse_quotes(records: DataFrame) -> DataFrame:
    """Prices from quote CSV, its columns found by header name.

    A payload without all of Symbol, Date and Close has no rows.
    """
    lines = _kind(records, "stooq").withColumn("lines", _lines(F.col("raw")))
    header = F.transform(_cells(F.get("lines", F.lit(0))), lambda h: F.trim(_unquote(h)))
    placed = lines.select("available_date", _flag(), "lines",
                          *[F.array_position(header, name).cast("int").alias(name) for name in ("Symbol", "Date", "Close")])
    placed = placed.filter("Symbol > 0 and Date > 0 and Close > 0")
    rows = placed.select("*", F.posexplode("lines").alias("pos", "line")).filter("pos > 0").withColumn("cells", _cells(F.col("line")))

    def cell(name):
        return _unquote(F.get("cells", F.col(name) - 1))

    parsed = rows.select(cell("Symbol").alias("symbol"), cell("Date").try_cast("timestamp_ntz").alias("event_date"),
                         F.col("available_date").try_cast("timestamp_ntz").alias("available_date"),
                         cell("Close").try_cast("double").alias("close"), "is_approximate")
    return parsed.filter("close is not null").select(*PRICES.fieldNames())


def parse_charts(records: DataFrame) -> DataFrame:
    """S3: prices from chart JSON. The event date keeps its UTC time of day; null closes are dropped."""
    result = F.get(F.from_json("raw", CHART)["chart"]["result"], F.lit(0))
    closes = F.get(result["indicators"]["quote"], F.lit(0))["close"]
    rows = _kind(records, "yahoo").select(
        source_symbol(F.col("source")).alias("symbol"), "available_date", _flag(),
        F.explode(F.arrays_zip(result["timestamp"].alias("t"), closes.alias("c"))).alias("p"))
    parsed = rows.filter("p.t is not null and p.c is not null").select(
        "symbol", F.to_utc_timestamp(F.timestamp_seconds("p.t"), F.current_timezone()).cast("timestamp_ntz").alias("event_date"),
        F.col("available_date").try_cast("timestamp_ntz").alias("available_date"), F.col("p.c").alias("close"), "is_approximate")
    return parsed.select(*PRICES.fieldNames())


def load_panel(records: DataFrame, price_series: Collection[str] = (), strict: bool = False,
               approximate: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prices, macro, listings) of all records; unknown sources carry no rows.

    Observation series named in ``price_series`` become price symbols. The listings
    come from all prices, before any strict filter.
    """
    known = usable_records(records)
    series = parse_observations(known)
    as_price = F.col("series").isin(list(price_series)) if price_series else F.lit(False)
    proxies = series.filter(as_price).select(F.col("series").alias("symbol"), "event_date", "available_date", F.col("value").alias("close"), "is_approximate")
    prices = proxies.unionByName(parse_quotes(known)).unionByName(parse_charts(known))
    macro = series.filter(~as_price)
    if approximate:
        prices, macro = approximate_availability(prices), approximate_availability(macro)
    listings = derive_listings(prices)
    return (strict_only(prices), strict_only(macro), listings) if strict else (prices, macro, listings)


def envelope(payloads: DataFrame, kind: str = "live", window_since: str | None = None, history_start: str | None = None) -> DataFrame:
    """(source, available_date, raw, event_date) stamped as a snapshot record.

    ``live`` records are exact; ``backfill`` and ``gap_fill`` ones are approximate and say so.
    """
    if kind not in ("live", "backfill", "gap_fill"):
        raise ValueError(f"unknown record kind: {kind}")
    late = kind != "live"
    stamps = {
        "is_approximate": F.lit(late), "captured_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
        "backfill": F.lit(True if late else None).cast("boolean"), "gap_fill": F.lit(True if kind == "gap_fill" else None).cast("boolean"),
        "gap_window_since": F.lit(window_since).cast("string"), "history_start": F.lit(history_start).cast("string")}
    return payloads.withColumns(stamps).select(*SNAPSHOT.fieldNames())


def gap_slices(observations: DataFrame, days: DataFrame, window_since: str) -> DataFrame:
    """(day, source, rows, last_event) of what each rebuilt day could have known.

    A day keeps the observations from the window's start up to itself, which are the
    first so many of its source's: a source becomes one row of them in order, no larger
    than the payload of its last day, and is cut for every day. The days are one row too.
    """
    inside = observations.filter(F.to_date("event_date") >= F.lit(window_since).cast("date"))
    # one payload holds at most one observation per event date
    newest = inside.groupBy("source", "event_date").agg(F.max_by("value", "available_date").alias("value"))
    sources = newest.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("event_date", "value"))).alias("all"))
    wanted = days.select(F.to_date("day").alias("day")).filter("day is not null").distinct().agg(F.sort_array(F.collect_list("day"))).scalar()
    known = F.filter("wanted", lambda d: d >= F.to_date(F.col("all")[0]["event_date"]))
    rows = sources.select("source", "all", wanted.alias("wanted")).select("source", "all", F.explode(known).alias("day")).select(
        "day", "source", F.filter("all", lambda x: F.to_date(x["event_date"]) <= F.col("day")).alias("rows"))
    return rows.withColumn("last_event", F.element_at("rows", -1)["event_date"])


def slices_to_csv(slices: DataFrame) -> DataFrame:
    """P8 as snapshot payloads: (source, available_date, raw, event_date)."""
    line = F.transform("rows", lambda x: F.concat_ws(",", F.date_format(x["event_date"], "yyyy-MM-dd"), x["value"].cast("string")))
    header = F.concat(F.lit("observation_date,"), source_symbol(F.col("source")))
    raw = F.concat(F.array_join(F.concat(F.array(header), line), "\n"), F.lit("\n"))
    return slices.select("source", F.date_format("day", "yyyy-MM-dd").alias("available_date"), raw.alias("raw"),
                         F.date_format("last_event", "yyyy-MM-dd").alias("event_date"))
