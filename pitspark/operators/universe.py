"""Which symbols share a window, how often they are sampled, and whether that is enough."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DAYS_PER_MONTH, cadence, months_between_dates, whole_days
from ..session import materialise
from .asof import usable
from .calendars import ntz
from .pit import event_span

# Market episodes used to label the windows a report spans.
EPISODES = [("dot_com", "2000-03-10"), ("gfc", "2008-09-15"), ("covid", "2020-03-23"), ("rate_shock_2022", "2022-06-16")]


def sampling(prices: DataFrame) -> DataFrame:
    """(symbol, median_days, cadence) of the gaps between distinct event dates; 0 for fewer than two.

    Gaps inside one day are zero whole days, so a day is reduced to its first and
    last event and a count before anything is ordered per symbol; a symbol with
    tick-level dates sorts as many rows as it has days.
    """
    dates = prices.select("symbol", "event_date").distinct()
    days = dates.groupBy("symbol", F.to_date("event_date").alias("day")).agg(
        F.min("event_date").alias("first"), F.max("event_date").alias("last"), F.count("*").alias("n"))
    before = F.lag("last").over(Window.partitionBy("symbol").orderBy("day"))
    runs = F.explode(F.array(F.struct(whole_days(F.col("before"), F.col("first")).cast("long").alias("gap"), F.lit(1).cast("long").alias("times")),
                             F.struct(F.lit(0).cast("long").alias("gap"), (F.col("n") - 1).alias("times"))))
    gaps = days.withColumn("before", before).select("symbol", runs.alias("r")).select("symbol", "r.gap", "r.times")
    known = gaps.filter("gap is not null and times > 0").groupBy("symbol").agg(
        F.percentile("gap", F.lit(0.5), F.col("times")).alias("median_days"))
    middle = prices.select("symbol").distinct().join(known, "symbol", "left").withColumn(
        "median_days", F.coalesce("median_days", F.lit(0.0)))
    return middle.withColumn("cadence", cadence(F.col("median_days")))


def shared_window(spans: DataFrame, by: list[str] | None = None) -> DataFrame:
    """[latest start, earliest end] and its length in months, -1 when disjoint."""
    window = spans.groupBy(*(by or [])).agg(F.max("start").alias("start"), F.min("end").alias("end"), F.count("*").alias("assets"))
    return window.withColumn("months", months_between_dates(F.col("start"), F.col("end")))


def cotemporal_universe(spans: DataFrame, min_months: float = 18.0, min_assets: int = 2) -> DataFrame:
    """Members (symbol, start, end) of the largest set sharing a window of ``min_months``.

    A set with latest start s shares [s, s + L] iff every member has start <= s and
    end - L >= s, so a member is an interval of admissible s and the largest set is
    the point most intervals cover. One sorted pass over interval ends finds it for
    any number of symbols. At a point of greatest cover no interval opens before the
    next one closes, hence the next closing is the members' earliest end. Ties go to
    the longest window, then to the lexicographically last sorted member list.
    """
    need = math.ceil(min_months * DAYS_PER_MONTH - 1e-9)
    last_start = F.col("end") - F.make_dt_interval(F.lit(need))
    fit = spans.select("symbol", "start", "end", last_start.alias("close")).filter("close >= start")
    steps = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("step")),
                              F.struct(F.col("close").alias("at"), F.lit(1).alias("kind"), F.lit(-1).alias("step"))))
    points = fit.select(steps.alias("p")).groupBy("p.at", "p.kind").agg(F.sum("p.step").alias("step"))
    covered = _running_cover(points)
    starts = covered.filter("kind = 0").withColumn("length", whole_days(F.col("at"), F.col("next_at")))
    best = starts.agg(F.max(F.struct("cover", "length")).alias("b")).select("b.*").head()
    if best is None or best["cover"] is None or best["cover"] < min_assets:
        return spans.filter(F.lit(False)).select("symbol", "start", "end")
    ties = [row["at"] for row in starts.filter((F.col("cover") == best["cover"]) & (F.col("length") == best["length"])).select("at").collect()]
    at = _lexicographically_last(fit, sorted(ties))
    return fit.filter((F.col("start") <= ntz(at)) & (F.col("close") >= ntz(at))).select("symbol", "start", "end")


def _running_cover(points: DataFrame) -> DataFrame:
    """Running sum over time in two levels: within each day, on top of the sum of the days before."""
    points = points.withColumn("day", F.to_date("at"))
    days = points.groupBy("day").agg(F.sum("step").alias("step"), F.min("at").alias("first"))
    order = Window.orderBy("day")
    base = days.select("day", (F.sum("step").over(order) - F.col("step")).alias("base"), F.lead("first").over(order).alias("next_first"))
    within = Window.partitionBy("day").orderBy("at", "kind")
    joined = points.join(base, "day")
    return joined.select("at", "kind", (F.col("base") + F.sum("step").over(within)).alias("cover"),
                         F.coalesce(F.lead("at").over(within), F.col("next_first")).alias("next_at"))


def _lexicographically_last(fit: DataFrame, ties: list):
    """Of sets of one size the last is the one without the smallest symbol that only some of them hold."""
    while len(ties) > 1:
        held = F.filter(F.array(*[ntz(t) for t in ties]), lambda t: (F.col("start") <= t) & (F.col("close") >= t))
        some = fit.withColumn("held", held).filter((F.size("held") > 0) & (F.size("held") < len(ties)))
        row = some.agg(F.min(F.struct("symbol", "held")).alias("m")).select("m.held").head()
        if row is None or row["held"] is None:
            break
        ties = [t for t in ties if t not in set(row["held"])]
    return ties[0]


def cotemporal_dates(prices: DataFrame, symbols: DataFrame) -> DataFrame:
    """Event dates on which all requested symbols that exist have a row; fewer than two give none."""
    mine = prices.join(symbols.select("symbol").distinct(), "symbol", "left_semi").select("symbol", "event_date").distinct()
    present = mine.agg(F.count_distinct("symbol")).scalar()
    return mine.groupBy("event_date").agg(F.count("*").alias("n")).filter((F.col("n") == present) & (present >= 2)).select("event_date")


def episodes_in(windows: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Each window repeated per episode inside it; swapped bounds are put right."""
    known = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(d).cast("timestamp_ntz").alias("date")) for n, d in EPISODES])
    low, high = F.least(start, end), F.greatest(start, end)
    inside = F.filter(known, lambda e: (e["date"] >= low) & (e["date"] <= high))
    return windows.withColumn("e", F.explode(inside)).select(*windows.columns, "e.name", "e.date")


def sufficiency(prices: DataFrame, min_assets: int = 2, min_months: float = 18.0) -> DataFrame:
    """One row saying whether the panel carries a walk-forward comparison, and why not.

    Its facts are a dozen scalars; the universe itself stays a table (J10).
    """
    return assess(prices, min_assets, min_months)[0]


def assess(prices: DataFrame, min_assets: int = 2, min_months: float = 18.0) -> tuple[DataFrame, DataFrame]:
    """A8 with what it rests on: the row of facts, and (symbol, start, end, median_days, cadence) of the shared universe."""
    # one pass over the quotes; what follows reads dates and spans per symbol
    dates = materialise(prices.groupBy("symbol", "event_date").agg(F.bool_or(usable(F.col("close"))).alias("ok")), "dates")
    spans = materialise(dates.filter("ok").groupBy("symbol").agg(F.min("event_date").alias("start"), F.max("event_date").alias("end")), "spans")
    members = materialise(cotemporal_universe(spans, min_months, min_assets), "members")
    extent = event_span(dates).select(
        F.col("start").alias("history_start"), F.col("end").alias("history_end"),
        F.round(months_between_dates(F.col("start"), F.col("end")), 4).alias("history_months"))
    everyone = shared_window(spans).select(F.col("assets").alias("asset_count"), F.col("months").alias("full_overlap"))
    shared = shared_window(members).select(
        F.col("assets").alias("universe_size"), F.col("start").alias("overlap_start"), F.col("end").alias("overlap_end"),
        F.when(F.col("assets") > 0, F.round("months", 4)).otherwise(0.0).alias("overlap_months"))
    chosen = members.agg(F.count("*")).scalar() > 0
    scope = spans.join(members.select("symbol", F.lit(True).alias("chosen")), "symbol", "left").filter(F.col("chosen") | ~chosen)
    rhythms = sampling(dates)
    rhythm = rhythms.join(scope.select("symbol"), "symbol", "left_semi").agg(
        F.coalesce(F.round(F.max("median_days"), 4), F.lit(0.0)).alias("coarsest_days"),
        (F.count_distinct("cadence") <= 1).alias("homogeneous"))
    # four rows of different columns folded into one, no join needed
    parts = extent
    for part in (everyone, shared, rhythm):
        parts = parts.unionByName(part, allowMissingColumns=True)
    row = parts.agg(*[F.max(c).alias(c) for c in parts.columns])
    thin = F.col("asset_count") < min_assets
    reason = (F.when(thin, "fewer_than_min_assets").when(F.col("universe_size") > 0, "ok")
              .when(F.col("full_overlap") >= 0, "history_below_min_window").otherwise("no_cotemporal_overlap"))
    facts = row.withColumn("reason", reason).withColumn("sufficient", F.col("reason") == "ok").withColumn(
        "min_assets", F.lit(min_assets)).withColumn("min_months", F.lit(float(min_months)))
    return facts, members.join(rhythms, "symbol")

