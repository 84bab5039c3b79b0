"""Calendars, rebalance triggers and walk-forward folds.

A calendar is configuration: a sorted list of as-of dates, at most a few thousand
of them whatever the panel weighs. It therefore enters a plan as a constant, not
as a join side, and panel rows find their calendar ordinal by an array lookup.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import local_table, materialise
from .ordering import neighbours, numbered

# Periods per year of the rebalance frequencies.
PERIODS_PER_YEAR = {"monthly": 12.0, "quarterly": 4.0, "semiannual": 2.0}
# How many ordered dates make one period.
DATE_STEP = {"monthly": 1, "quarterly": 3, "semiannual": 6}

MAX_CALENDAR_DATES = 50_000


def as_timestamp(value) -> datetime:
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime.combine(value, time())
    return datetime.fromisoformat(str(value))


def ntz(value) -> Column:
    """A zone-free timestamp literal.

    A plain literal would carry a time zone: comparing with it shifts in sessions of
    another zone and keeps the filter from reaching the files.
    """
    return F.lit(as_timestamp(value).isoformat(sep=" ")).cast("timestamp_ntz")


@dataclass(frozen=True)
class Calendar:
    """Strictly increasing as-of dates; ``k`` is the zero-based ordinal."""

    dates: tuple[datetime, ...]

    def __post_init__(self):
        if not self.dates:
            raise ValueError("a calendar needs at least one date")
        if any(a >= b for a, b in zip(self.dates, self.dates[1:])):
            raise ValueError("calendar dates must be strictly increasing")

    def __len__(self) -> int:
        return len(self.dates)

    @classmethod
    def of(cls, values) -> "Calendar":
        return cls(tuple(sorted({as_timestamp(v) for v in values})))

    @classmethod
    def between(cls, start, end, frequency: str = "monthly") -> "Calendar":
        """Period ends inside [start, end]; semiannual is every second quarter end."""
        start, end = as_timestamp(start), as_timestamp(end)
        if frequency not in PERIODS_PER_YEAR:
            raise ValueError(f"no rebalancing known by the name {frequency}")
        months = 1 if frequency == "monthly" else 3
        out, year, month = [], start.year, start.month
        while datetime(year, month, 1) <= end:
            following = datetime(year + month // 12, month % 12 + 1, 1)
            if month % months == 0 and start <= following - timedelta(days=1) <= end:
                out.append(following - timedelta(days=1))
            year, month = following.year, following.month
        return cls(tuple(out[::2] if frequency == "semiannual" else out))

    @classmethod
    def collect(cls, frame: DataFrame, column: str = "as_of") -> "Calendar":
        """Bring a calendar-sized frame to the driver; refuses anything larger."""
        rows = frame.select(column).distinct().limit(MAX_CALENDAR_DATES + 1).collect()
        if len(rows) > MAX_CALENDAR_DATES:
            raise ValueError("more dates than a calendar may hold")
        return cls.of(r[0] for r in rows)

    @property
    def daily(self) -> bool:
        return all(d.time() == time() for d in self.dates)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(k, as_of, next_as_of), a local relation."""
        rows = [(k, d, self.dates[k + 1] if k + 1 < len(self) else None) for k, d in enumerate(self.dates)]
        return local_table(spark, rows, "k int, as_of timestamp_ntz, next_as_of timestamp_ntz")

    def as_of(self, k: Column) -> Column:
        """Ordinal to date, a constant-array lookup."""
        return F.get(constant_array(self.dates, "timestamp_ntz"), k)

    def ordinal(self, t: Column) -> Column:
        """Ordinal of the first calendar date at or after ``t``; null after the last one."""
        if not self.daily:
            k = F.size(F.filter(constant_array(self.dates, "timestamp_ntz"), lambda d: d < t))
            return F.when(t.isNotNull() & (k < len(self)), k)
        first, last = self.dates[0].date(), self.dates[-1].date()
        lookup, k = [], 0
        for offset in range((last - first).days + 1):
            if self.dates[k].date() < first + timedelta(days=offset):
                k += 1
            lookup.append(k)
        # a time of day after midnight is only visible from the next day on
        day = F.to_date(t + F.expr("INTERVAL '1' DAY - INTERVAL '0.000001' SECOND"))
        offset = F.greatest(F.date_diff(day, F.lit(first)), F.lit(0))
        return F.when(t.isNotNull(), F.get(constant_array(lookup, "int"), offset))

    def select(self, keep) -> "Calendar":
        return Calendar(tuple(d for k, d in enumerate(self.dates) if k in set(keep)))


def constant_array(values, sql_type: str) -> Column:
    """An array literal; written as text so the optimizer folds it into one constant."""
    text = ",".join(str(v) for v in values)
    return F.expr(f"cast(split('{text}', ',') as array<{sql_type}>)")


# -- calendars as tables ------------------------------------------------------


def period_ends(extent: DataFrame, frequency: str = "monthly", start: str = "start", end: str = "end") -> DataFrame:
    """one row per period end inside the [start, end] of each extent row."""
    months = F.explode(F.sequence(F.trunc(start, "month"), F.to_date(F.col(end)), F.expr("interval 1 month")))
    ends = extent.select(F.to_date(F.col(start)).alias("lo"), F.to_date(F.col(end)).alias("hi"), months.alias("m"))
    ends = ends.select("lo", "hi", F.last_day("m").alias("d")).filter("d between lo and hi")
    if frequency != "monthly":
        ends = ends.filter(F.month("d") % 3 == 0)
    if frequency == "semiannual":
        rank = F.row_number().over(Window.partitionBy("lo", "hi").orderBy("d"))
        ends = ends.withColumn("rank", rank).filter(F.col("rank") % 2 == 1)
    return ends.select(F.col("d").cast("timestamp_ntz").alias("as_of")).distinct()


def business_days(extent: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """every weekday of the inclusive range."""
    days = extent.select(F.explode(F.sequence(F.to_date(F.col(start)), F.to_date(F.col(end)))).alias("day"))
    return days.filter(F.weekday("day") < 5).distinct()


def event_dates(rows: DataFrame, start, end) -> DataFrame:
    """Distinct event dates inside [start, end], the replay calendar."""
    return (rows.filter(F.col("event_date").between(ntz(start), ntz(end)))
            .select(F.col("event_date").alias("as_of")).distinct())


# -- rebalance triggers -------------------------------------------------------


def every_nth(dates: DataFrame, frequency: str | None) -> DataFrame:
    """Each n-th date in order; no frequency means no dates."""
    if frequency is None:
        return dates.filter(F.lit(False))
    if frequency not in DATE_STEP:
        raise ValueError(f"no rebalancing known by the name {frequency}")
    placed = numbered(dates, F.asc("as_of"), column="place")
    return placed.filter(F.col("place") % DATE_STEP[frequency] == 0).drop("place")


def on_change_or_due(labelled: DataFrame, frequency: str | None) -> DataFrame:
    """First date, dates due by time, and dates whose label left the previous one."""
    if frequency is not None and frequency not in DATE_STEP:
        raise ValueError(f"no rebalancing known by the name {frequency}")
    due = F.lit(False) if frequency is None else F.col("place") % DATE_STEP[frequency] == 0
    # numbered rows are read twice, once as each other's predecessors
    marked = neighbours(materialise(numbered(labelled, F.asc("as_of"), column="place"), "placed"), "label", -1, "before", "place")
    return (marked.filter((F.col("place") == 1) | due | (F.col("label") != F.col("before")))
            .drop("place", "before"))


def require_labels(dates: DataFrame, labels: DataFrame) -> DataFrame:
    """Every date must carry a label; a missing one stops the job."""
    joined = dates.join(labels, "as_of", "left")
    known = F.when(F.col("label").isNull(), F.raise_error(F.concat(F.lit("no label known on "), F.col("as_of").cast("string"))))
    return joined.withColumn("label", F.coalesce("label", known.cast("string")))


# -- walk-forward folds -------------------------------------------------------


@dataclass(frozen=True)
class WalkForward:
    train_months: int
    test_months: int
    step_months: int


def folds(calendar: Calendar, plan: WalkForward) -> list[tuple[int, datetime, datetime, datetime]]:
    """(fold, train_start, test_start, test_end).

    Each cursor moves on from the one before it, so a month end clamped once stays clamped.
    """
    def later(day, months):
        return (pd.Timestamp(day) + pd.DateOffset(months=months)).to_pydatetime()

    out, cursor, last = [], calendar.dates[0], calendar.dates[-1]
    while cursor <= last and later(cursor, plan.train_months) <= last:
        test_start = later(cursor, plan.train_months)
        out.append((len(out), cursor, test_start, later(test_start, plan.test_months)))
        cursor = later(cursor, plan.step_months)
    return out


def fold_members(dates: DataFrame, plan: WalkForward) -> DataFrame:
    """J6 as a table over (as_of): (fold, segment, as_of), one row per fold a date lies in.

    The fold bounds are one row, found from the first and the last date, and every date looks up
    its folds in it.
    """
    def months(n: int) -> Column:
        return F.make_ym_interval(F.lit(0), F.lit(n))

    ends = dates.agg(F.min("as_of").alias("first"), F.max("as_of").alias("last")).filter("first is not null")
    steps = F.floor(F.months_between("last", "first") / plan.step_months).cast("int") + 1
    starts = F.aggregate(F.sequence(F.lit(1), steps), F.array("first"),
                         lambda done, _: F.concat(done, F.array(F.element_at(done, -1) + months(plan.step_months))))
    spans = F.transform(starts, lambda s, i: F.struct(
        i.alias("fold"), s.alias("start"), (s + months(plan.train_months)).alias("split"), (s + months(plan.train_months) + months(plan.test_months)).alias("stop")))
    bounds = ends.select(F.filter(spans, lambda f: f["split"] <= F.col("last")).alias("folds")).scalar()
    placed = dates.select("as_of", bounds.alias("folds"))
    mine = placed.select("as_of", F.explode(F.filter("folds", lambda f: (f["start"] <= F.col("as_of")) & (F.col("as_of") < f["stop"]))).alias("f"))
    segment = F.when(F.col("as_of") < F.col("f.split"), "in_sample").otherwise("out_of_sample")
    return mine.select("f.fold", segment.alias("segment"), "as_of")


def next_dates(dates: DataFrame) -> DataFrame:
    """W14 as a table over distinct (as_of): the date that follows each, null after the last."""
    placed = materialise(numbered(dates.select("as_of"), F.asc("as_of"), column="place"), "placed")
    return neighbours(placed, "as_of", 1, "next_as_of", "place").drop("place")


def segments(calendar: Calendar, plan: WalkForward | None) -> dict[str, list[int]]:
    """Ordinals of each segment, the union over folds."""
    out = {"full": list(range(len(calendar)))}
    if plan is None:
        return out
    spans = folds(calendar, plan)
    out["in_sample"] = [k for k, d in enumerate(calendar.dates) if any(a <= d < b for _, a, b, _ in spans)]
    out["out_of_sample"] = [k for k, d in enumerate(calendar.dates) if any(b <= d < c for _, _, b, c in spans)]
    return out
