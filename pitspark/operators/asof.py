"""As-of reads over a whole calendar at once.

Every row is first given the ordinal of the earliest calendar date that can see
it (a constant-array lookup in the scan stage) and the rows are then reduced per
(key, ordinal). That reduction combines map-side, so a key holding a third of the
table leaves each task as at most one row per calendar date; the running maximum
that follows sorts calendar-sized groups only. No join against the calendar, no
fan-out of raw rows, nothing to salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calendars import Calendar, ntz

# Orders of "latest". They differ on purpose and give different answers.
BY_RELEASE = ("available_date", "event_date")
BY_PERIOD = ("event_date", "available_date")

#: cells (rows x dates) that a part may at most unfold into
CELLS = 8_000_000


def usable(close: Column) -> Column:
    """Finite and positive. NaN sorts above every number, hence the explicit test."""
    return close.isNotNull() & ~F.isnan(close) & (close > 0.0) & (close < float("inf"))


def present(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def first_visible(rows: DataFrame, calendar: Calendar, time: str = "available_date") -> DataFrame:
    """Add ``k``, the first calendar ordinal that may see the row."""
    seen = rows.filter(F.col(time) <= ntz(calendar.dates[-1]))
    return seen.withColumn("k", calendar.ordinal(F.col(time)))


def _parts(rows: DataFrame, calendar: Calendar) -> int:
    """Number of parts in which rows are spread over the dates; grows with the table.

    A shuffle before that would be coalesced by its own few bytes, whatever unfolds from them.
    """
    return max(1, -(-rows.count() * len(calendar) // CELLS))


def _until(calendar: Calendar, following: Column) -> Column:
    return F.coalesce(following, F.lit(len(calendar)))


def latest_spans(rows: DataFrame, calendar: Calendar, key: str = "symbol",
                 order: tuple[str, ...] = BY_RELEASE, value: str = "close") -> DataFrame:
    """(key, k, until, order columns, value): the row in force on ordinals k .. until-1."""
    newest = (first_visible(rows, calendar).groupBy(key, "k")
              .agg(F.max(F.struct(*order, value)).alias("row"))
              .repartition(_parts(rows, calendar), key))
    steps = Window.partitionBy(key).orderBy("k")
    return newest.select(
        key, "k", _until(calendar, F.lead("k").over(steps)).alias("until"),
        F.max("row").over(steps.rowsBetween(Window.unboundedPreceding, 0)).alias("row"),
    ).select(key, "k", "until", "row.*")


def latest_asof(rows: DataFrame, calendar: Calendar, key: str = "symbol",
                order: tuple[str, ...] = BY_RELEASE, value: str = "close") -> DataFrame:
    """(key, k, as_of, order columns, value) on every date with something available."""
    spans = latest_spans(rows, calendar, key, order, value)
    cells = spans.select(key, F.explode(F.sequence("k", F.col("until") - 1)).alias("k"), *order, value)
    return cells.withColumn("as_of", calendar.as_of(F.col("k")))


# -- dates that are a table ---------------------------------------------------
#
# Neither probes nor dates are brought to the driver here, and their number is not limited.
# Time is cut into parts of some hours. What was known when a part began is a running maximum
# over the newest row of each part, one row per (key, part); inside a part quotes and probes
# are ordered together. Rows are dealt by (key, part), so a key that holds a third of all rows
# still spreads over its parts.


def _part(t: Column, hours: int) -> Column:
    """Number of the part of ``hours`` that a time lies in; growing with time."""
    return F.floor((F.datediff(t, F.lit("1970-01-01")).cast("long") * 24 + F.hour(t)) / hours)


def _quoted(quotes: DataFrame, key: str, available: str, order: tuple[str, ...], value: str, hours: int) -> DataFrame:
    known = quotes.filter(F.col(available).isNotNull())
    return known.select(key, F.col(available).alias("t"), _part(F.col(available), hours).alias("part"), F.struct(*order, value).alias("row"))


def _inside(key: str) -> Column:
    """The newest row up to now within the part; rows of one moment see each other."""
    return F.max("row").over(Window.partitionBy(key, "part").orderBy("t").rangeBetween(Window.unboundedPreceding, 0))


def asof_join(probes: DataFrame, quotes: DataFrame, key: str = "symbol", time: str = "as_of", available: str = "available_date",
              order: tuple[str, ...] = BY_RELEASE, value: str = "close", hours: int = 24) -> DataFrame:
    """J1 / J2 for probes of any number: every probe row, ``order`` columns and ``value`` of the row in force for its key then.

    A probe sees what was available at its own moment. Without a key, a time or anything
    visible the added columns are null; equal probes are answered each.
    """
    quoted = _quoted(quotes, key, available, order, value, hours)
    probe = F.struct(*[F.col(c) for c in probes.columns])
    asked = probes.select(F.col(key), F.col(time).alias("t"), _part(F.col(time), hours).alias("part"), probe.alias("probe"))
    both = quoted.unionByName(asked, allowMissingColumns=True)
    tops = both.groupBy(key, "part").agg(F.max("row").alias("top"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(key, "part", F.max("top").over(before).alias("carry"))
    seen = both.select(key, "part", "probe", _inside(key).alias("inside")).filter("probe is not null")
    found = seen.join(carried, [key, "part"], "left").select("probe", F.when(
        F.col(key).isNotNull() & F.col("part").isNotNull(), F.greatest("inside", "carry")).alias("row"))
    added = [c for c in (*order, value) if c not in probes.columns]
    return found.select("probe.*", *[F.col(f"row.{c}") for c in added])


def latest_over(rows: DataFrame, dates: DataFrame, key: str = "symbol", order: tuple[str, ...] = BY_RELEASE, value: str = "close",
                available: str = "available_date", hours: int = 24) -> DataFrame:
    """J1 / J2 over a table of dates (as_of): (key, as_of, order columns, value) on every date with something available.

    A part in which a key has no quote takes the row carried into it, without any sort; only
    the dates of other parts are ordered among the quotes.
    """
    quoted = _quoted(rows, key, available, order, value, hours)
    asked = dates.filter("as_of is not null").select("as_of").distinct().withColumn("part", _part(F.col("as_of"), hours))
    first, last = (asked.agg(f("part")).scalar() for f in (F.min, F.max))
    steps = Window.partitionBy(key).orderBy("part")
    spans = quoted.groupBy(key, "part").agg(F.max("row").alias("top")).select(
        key, "part", F.lead("part").over(steps).alias("following"), F.max("top").over(steps.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.max("top").over(steps.rowsBetween(Window.unboundedPreceding, 0)).alias("row"))
    start, stop = F.greatest(F.col("part") + 1, first), F.least(F.coalesce(F.col("following") - 1, last), last)
    quiet = spans.filter(start <= stop).select(key, F.explode(F.sequence(start, stop)).alias("part"), "row").join(asked, "part").select(key, "as_of", "row")
    busy = spans.select(key, "part", F.col("before").alias("carry")).join(asked, "part").withColumn("t", F.col("as_of"))
    both = busy.unionByName(quoted.join(asked.select("part").distinct(), "part", "left_semi"), allowMissingColumns=True)
    moved = both.select(key, "as_of", F.greatest(_inside(key), "carry").alias("row")).filter("as_of is not null and row is not null")
    return quiet.unionByName(moved).select(key, "as_of", *[F.col(f"row.{c}") for c in (*order, value)])


def price_legs(prices: DataFrame, calendar: Calendar) -> DataFrame:
    """(symbol, k, close, leg): as-of close and the return to the next calendar date.

    The price is picked first and judged afterwards: an unusable latest row makes
    the leg null, it never falls back to an older price.
    """
    spans = latest_spans(prices, calendar)
    steps = Window.partitionBy("symbol").orderBy("k")
    following = F.lead("close").over(steps)
    held = spans.select("symbol", "k", "until", "close", following.alias("after"))
    cells = held.select("symbol", F.explode(F.sequence("k", F.col("until") - 1)).alias("k"), "until", "close", "after")
    last = F.col("k") == len(calendar) - 1
    moves = F.col("k") == F.col("until") - 1
    leg = (F.when(last | ~usable(F.col("close")), None)
           .when(~moves, 0.0)
           .when(usable(F.col("after")), F.col("after") / F.col("close") - 1.0))
    return cells.select("symbol", "k", "close", leg.alias("leg"))


def history_asof(prices: DataFrame, calendar: Calendar, last: int | None = None,
                 dropna: bool = True, exact: bool = True) -> DataFrame:
    """J4 + W9: (k, symbol, event_date, close), for each date the history visible then.

    Per (symbol, event_date) the newest available version counts. With ``last``
    only the newest that many event dates are kept; an event date is expanded no
    further than the ordinal at which that many later ones are certainly visible,
    so the expansion is calendar x last per symbol, not calendar x history. With
    ``exact`` off the caller trims the few surplus rows itself.
    """
    version = F.max(F.struct("available_date", "close")).alias("row")
    versions = first_visible(prices, calendar).groupBy("symbol", "event_date", "k").agg(version)
    # one row per event date; at most one version per calendar date
    dates = versions.groupBy("symbol", "event_date").agg(
        F.min("k").alias("seen"),
        F.sort_array(F.collect_list(F.struct("k", "row"))).alias("versions"),
        F.bool_or(~present(F.col("row.close"))).alias("flawed"),
    )
    parts = _parts(prices, calendar)
    if last is None:
        # by symbol before it unfolds: what orders a symbol's history needs no shuffle of the cells
        dates = dates.repartition(parts, "symbol").withColumn("out", F.lit(len(calendar)))
    else:
        dates = _drop_out(dates, calendar, last, parts)
    spans = dates.select("symbol", "event_date", "out", F.posexplode("versions").alias("i", "v"), "versions")
    until = F.least(F.coalesce(F.get("versions", F.col("i") + 1)["k"], F.lit(len(calendar))), F.col("out"))
    # versions arrive in order of first visibility, so a later one always supersedes
    spans = spans.select("symbol", "event_date", F.col("v.k").alias("k"), until.alias("until"), F.col("v.row.close").alias("close"))
    if dropna:
        spans = spans.filter(present(F.col("close")))
    rows = (spans.filter("k < until")
            .select("symbol", "event_date", F.explode(F.sequence("k", F.col("until") - 1)).alias("k"), "close"))
    return rows if last is None or not exact else last_rows(rows, last)


def _drop_out(dates: DataFrame, calendar: Calendar, last: int, parts: int) -> DataFrame:
    """Add ``out``: from this ordinal on the event date is not among the newest ``last``.

    An event date with ``last`` later ones first seen on the same calendar date is
    never among them and goes at once; that filter runs map-side too, so a symbol
    with tick-level event dates does not reach one task whole. Event dates with a
    missing value in any version cannot vouch for others and are left alone.
    """
    rank = F.row_number().over(Window.partitionBy("symbol", "seen").orderBy(F.desc("event_date")))
    sound = dates.filter("not flawed").withColumn("rank", rank).filter(F.col("rank") <= last).drop("rank")
    kept = sound.unionByName(dates.filter("flawed")).repartition(parts, "symbol")
    later = Window.partitionBy("symbol").orderBy("event_date").rowsBetween(1, last)
    sure = F.when(F.col("flawed"), len(calendar)).otherwise(F.col("seen"))
    full = F.count("*").over(later) == last
    return kept.withColumn("out", F.when(full, F.max(sure).over(later)).otherwise(len(calendar)))


def last_rows(history: DataFrame, n: int) -> DataFrame:
    """The newest n event dates per (date, symbol)."""
    newest = Window.partitionBy("symbol", "k").orderBy(F.desc("event_date"))
    return history.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= n).drop("rank")


def period_returns(history: DataFrame, last: int | None = None) -> DataFrame:
    """Close over the previous close per (date, symbol), first row dropped.

    With ``last`` only the newest that many returns; rank and previous close come
    from one sort.
    """
    back = Window.partitionBy("symbol", "k").orderBy(F.desc("event_date"))
    out = history.select("*", F.lead("close").over(back).alias("before"),
                         *([] if last is None else [F.row_number().over(back).alias("rank")]))
    out = out.filter(F.col("before").isNotNull())
    if last is not None:
        out = out.filter(F.col("rank") <= last).drop("rank")
    return out.withColumn("ret", F.when(F.col("before") != 0, F.col("close") / F.col("before") - 1.0)).drop("before")


def complete_dates(history: DataFrame, symbols: list[str]) -> DataFrame:
    """Rows of the listed symbols on event dates where each of them has a value."""
    mine = history.filter(F.col("symbol").isin(symbols) & present(F.col("close")))
    whole = (mine.groupBy("k", "event_date").agg(F.count_distinct("symbol").alias("n"))
             .filter(F.col("n") == len(set(symbols))).select("k", "event_date"))
    return mine.join(whole, ["k", "event_date"], "left_semi")


def align_panel(prices: DataFrame, macro: DataFrame, calendar: Calendar) -> DataFrame:
    """Long (as_of, name, value) of as-of prices and macro values."""
    px = latest_asof(prices, calendar).select("as_of", F.col("symbol").alias("name"), F.col("close").alias("value"))
    mx = latest_asof(macro, calendar, "series", BY_PERIOD, "value").select("as_of", F.col("series").alias("name"), "value")
    return px.unionByName(mx)


def align_wide(panel: DataFrame, calendar: Calendar, names: list[str]) -> DataFrame:
    """J3 at the output: one column per requested name, a row for every calendar date."""
    dates = calendar.frame(panel.sparkSession).select("as_of")
    wide = panel.filter(F.col("name").isin(names)).groupBy("as_of").pivot("name", names).agg(F.first("value"))
    return dates.join(wide, "as_of", "left")
