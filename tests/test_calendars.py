from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitspark.operators import calendars as c


def d(text):
    return datetime.fromisoformat(text)


def test_period_ends_inside_the_range():
    assert [x.month for x in c.Calendar.between("2020-01-01", "2020-12-31", "quarterly").dates] == [3, 6, 9, 12]
    assert c.Calendar.between("2020-02-15", "2020-04-29").dates == (d("2020-02-29"), d("2020-03-31"))
    # every second quarter end, counted from the first one inside the range
    assert [(x.year, x.month) for x in c.Calendar.between("2020-04-01", "2021-12-31", "semiannual").dates] == [
        (2020, 6), (2020, 12), (2021, 6), (2021, 12)]
    with pytest.raises(ValueError):
        c.Calendar.between("2020-01-01", "2020-12-31", "hourly")


def test_fold_cursors_keep_a_clamped_month_end():
    days = c.Calendar.of([d("2020-01-31"), d("2020-02-29"), d("2020-03-31"), d("2020-04-30"), d("2020-05-31")])
    starts = [start for _, start, *_ in c.folds(days, c.WalkForward(1, 1, 1))]
    assert starts[:3] == [d("2020-01-31"), d("2020-02-29"), d("2020-03-29")]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 24), st.integers(1, 12), st.integers(1, 12), st.integers(2, 60))
def test_training_ends_before_testing_starts(train, test, step, months):
    days = c.Calendar.between("2000-01-01", f"{2000 + months // 12}-{months % 12 + 1:02d}-28")
    for _, start, split, stop in c.folds(days, c.WalkForward(train, test, step)):
        assert start < split < stop
        assert split <= days.dates[-1]


def test_regime_schedule_fires_first_due_and_changed(spark):
    days = c.Calendar.between("2020-01-01", "2020-06-30").dates
    labels = ["on", "on", "on", "def", "def", "on"]
    rows = spark.createDataFrame(list(zip(days, labels)), "as_of timestamp_ntz, label string")
    kept = [r["as_of"] for r in c.on_change_or_due(rows, "quarterly").orderBy("as_of").collect()]
    assert kept == [days[0], days[2], days[3], days[5]]
    assert c.every_nth(rows, None).count() == 0
    with pytest.raises(ValueError):
        c.every_nth(rows, "weekly")


def test_missing_label_stops_the_job(spark):
    days = spark.createDataFrame([(d("2020-01-31"),), (d("2020-02-29"),)], "as_of timestamp_ntz")
    labels = spark.createDataFrame([(d("2020-01-31"), "on")], "as_of timestamp_ntz, label string")
    with pytest.raises(Exception, match="no label known"):
        c.require_labels(days, labels).collect()


def test_business_days_skip_weekends(spark):
    span = spark.createDataFrame([("2026-06-12", "2026-06-16")], "start string, end string")
    assert sorted(str(r["day"]) for r in c.business_days(span).collect()) == ["2026-06-12", "2026-06-15", "2026-06-16"]


def test_ordinals_are_null_outside_the_calendar(spark):
    days = c.Calendar.between("2020-01-01", "2020-03-31")
    rows = spark.createDataFrame([(d("2019-05-01"),), (d("2020-01-31"),), (d("2020-01-31 00:00:01"),), (d("2020-04-01"),), (None,)], "t timestamp_ntz")
    assert [r["k"] for r in rows.select(days.ordinal(F.col("t")).alias("k")).collect()] == [0, 0, 1, None, None]
