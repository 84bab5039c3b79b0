"""As-of reads over tables of dates and probes, against a scan of all rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pitspark.operators import asof

QUOTE = "symbol string, event_date timestamp_ntz, available_date timestamp_ntz, close double, part long, t string"
ZERO = datetime(1999, 12, 30)


def _quotes(seed, n):
    draw = random.Random(seed)
    hot = [("HOT" if draw.random() < 0.5 else draw.choice("ABC"), ZERO + timedelta(hours=draw.randrange(0, 200)),
            ZERO + timedelta(minutes=draw.randrange(0, 60 * 24 * 9, 15)), float(draw.randrange(100)), 0, "x") for _ in range(n)]
    return hot + [("A", ZERO, None, 1.0, 0, "x"), (None, ZERO, ZERO, 2.0, 0, "x"), hot[0]]


def _newest(quotes, key, when, order):
    rows = [q for q in quotes if q[0] == key and q[2] is not None and q[2] <= when]
    rank = (lambda q: (q[2], q[1], q[3])) if order == asof.BY_RELEASE else (lambda q: (q[1], q[2], q[3]))
    return max(rows, key=rank) if rows else None


@pytest.mark.parametrize("order", [asof.BY_RELEASE, asof.BY_PERIOD])
@pytest.mark.parametrize("hours", [24, 5])
def test_latest_over_a_table_of_dates(spark, order, hours):
    quotes = _quotes(hours, 150)
    draw = random.Random(9)
    dates = [ZERO + timedelta(minutes=draw.randrange(-2000, 60 * 24 * 20, 5)) for _ in range(80)] + [ZERO + timedelta(days=2)] * 2 + [None]
    frame = spark.createDataFrame([(d, "y") for d in dates], "as_of timestamp_ntz, row string")
    got = asof.latest_over(spark.createDataFrame(quotes, QUOTE), frame, order=order, hours=hours)
    want = set()
    for d in {d for d in dates if d}:
        for key in ("HOT", "A", "B", "C", None):
            best = _newest(quotes, key, d, order)
            if best:
                want.add((key, d, best[1], best[2], best[3]))
    rows = [(r["symbol"], r["as_of"], r["event_date"], r["available_date"], r["close"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


@pytest.mark.parametrize("order", [asof.BY_RELEASE, asof.BY_PERIOD])
def test_probes_are_answered_one_by_one(spark, order):
    quotes = _quotes(3, 120)
    draw = random.Random(4)
    probes = [(i, draw.choice(["HOT", "A", "Z"]), ZERO + timedelta(minutes=draw.randrange(-500, 60 * 24 * 12))) for i in range(90)]
    probes += [probes[0], (91, None, ZERO), (92, "A", None), (93, "HOT", quotes[0][2])]
    got = asof.asof_join(spark.createDataFrame(probes, "id long, symbol string, as_of timestamp_ntz"), spark.createDataFrame(quotes, QUOTE), order=order, hours=7)
    want = []
    for i, key, when in probes:
        best = _newest(quotes, key, when, order) if key and when else None
        want.append((i, key, when, *(best[1:4] if best else (None,) * 3)))
    rows = [(r["id"], r["symbol"], r["as_of"], r["event_date"], r["available_date"], r["close"]) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_no_dates_and_no_quotes(spark):
    quotes = spark.createDataFrame(_quotes(1, 5), QUOTE)
    none = spark.createDataFrame([], "as_of timestamp_ntz")
    assert asof.latest_over(quotes, none).collect() == []
    assert asof.latest_over(quotes.limit(0), spark.createDataFrame([(ZERO,)], "as_of timestamp_ntz")).collect() == []
    assert asof.asof_join(none.withColumn("symbol", F.lit("A")), quotes).collect() == []


def test_more_dates_than_a_constant_could_hold(spark):
    """A date each second, far more than a calendar may have."""
    quotes = spark.createDataFrame([("A", ZERO, ZERO + timedelta(seconds=3600 * i), float(i), 0, "x") for i in range(20)], QUOTE)
    dates = spark.range(72_000).select((F.lit(ZERO) + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).cast("timestamp_ntz").alias("as_of"))
    got = asof.latest_over(quotes, dates).groupBy("close").count().collect()
    assert sorted((r["close"], r["count"]) for r in got) == [(float(i), 3600) for i in range(20)]
