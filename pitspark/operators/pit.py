"""Point-in-time filters, single-date reads and panel extents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import BY_PERIOD, BY_RELEASE, usable
from .calendars import Calendar, ntz


def available_at(rows: DataFrame, as_of) -> DataFrame:
    """The one guard against look-ahead."""
    return rows.filter(F.col("available_date") <= ntz(as_of))


def strict_only(rows: DataFrame) -> DataFrame:
    """Drop approximate rows; a table without the flag passes unchanged."""
    return rows.filter(~F.col("is_approximate")) if "is_approximate" in rows.columns else rows


def usable_prices(prices: DataFrame) -> DataFrame:
    """P3 for extents: the filter comes before any span logic."""
    return prices.filter(usable(F.col("close")))


def symbols(prices: DataFrame) -> DataFrame:
    """P4"""
    return prices.select("symbol").distinct()


def restrict(prices: DataFrame, wanted: DataFrame) -> DataFrame:
    """P5: keep the symbols of another table."""
    return prices.join(wanted.select("symbol").distinct(), "symbol", "left_semi")


def approximate_availability(rows: DataFrame) -> DataFrame:
    """Research mode, every row known on its event date. Not point-in-time."""
    return rows.withColumn("available_date", F.col("event_date"))


def _newest(rows: DataFrame, as_of, key: str, order, value: str) -> DataFrame:
    row = F.max(F.struct(*order, value)).alias("row")
    return available_at(rows, as_of).groupBy(key).agg(row).select(key, "row.*")


def get(prices: DataFrame, as_of) -> DataFrame:
    """J1 for one date: newest row per symbol by (available_date, event_date)."""
    return _newest(prices, as_of, "symbol", BY_RELEASE, "close")


def macro(rows: DataFrame, as_of) -> DataFrame:
    """J2 for one date: newest row per series by (event_date, available_date)."""
    return _newest(rows, as_of, "series", BY_PERIOD, "value")


def history(prices: DataFrame, as_of) -> DataFrame:
    """Newest available version of each (symbol, event_date)."""
    row = F.max(F.struct("available_date", "close")).alias("row")
    return available_at(prices, as_of).groupBy("symbol", "event_date").agg(row).select("symbol", "event_date", "row.*")


def universe(listings: DataFrame, calendar: Calendar) -> DataFrame:
    """(as_of, symbol) of the listings alive on each date, delisted ones included while they lived."""
    first = calendar.ordinal(F.col("list_date"))
    gone = F.coalesce(calendar.ordinal(F.col("delist_date")), F.lit(len(calendar)))
    alive = listings.select("symbol", first.alias("k"), gone.alias("until")).filter("k < until")
    alive = alive.select("symbol", F.explode(F.sequence("k", F.col("until") - 1)).alias("k"))
    return alive.select(calendar.as_of(F.col("k")).alias("as_of"), "symbol")


def derive_listings(prices: DataFrame) -> DataFrame:
    """A4: listed on the first event date, never delisted."""
    return prices.groupBy("symbol").agg(F.min("event_date").alias("list_date")).withColumn(
        "delist_date", F.lit(None).cast("timestamp_ntz"))


def event_span(prices: DataFrame) -> DataFrame:
    """A5"""
    return prices.agg(F.min("event_date").alias("start"), F.max("event_date").alias("end"))


def asset_spans(prices: DataFrame) -> DataFrame:
    """Extent per symbol over usable closes; a symbol without one drops out."""
    return usable_prices(prices).groupBy("symbol").agg(
        F.min("event_date").alias("start"), F.max("event_date").alias("end"))
