"""Look-ahead, survivorship, revisions: hand-made tables with known answers."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitspark.operators import asof, pit
from pitspark.operators.calendars import Calendar
from pitspark.schemas import LISTINGS, MACRO, PRICES


def ts(text):
    return datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def toy(spark):
    prices = spark.createDataFrame([
        ("AAA", ts("2020-01-31"), ts("2020-01-31"), 100.0, False), ("AAA", ts("2020-02-29"), ts("2020-02-29"), 110.0, True),
        ("BBB", ts("2020-01-31"), ts("2020-01-31"), 50.0, False), ("BBB", ts("2020-02-29"), ts("2020-02-29"), 55.0, False)], PRICES)
    listings = spark.createDataFrame([("AAA", ts("2019-01-01"), None), ("BBB", ts("2019-01-01"), ts("2020-03-15"))], LISTINGS)
    macro = spark.createDataFrame([
        ("CPI", ts("2020-01-01"), ts("2020-02-12"), 256.0, False), ("CPI", ts("2020-01-01"), ts("2020-03-11"), 256.4, False),
        ("CPI", ts("2020-02-01"), ts("2020-03-12"), 257.0, False)], MACRO)
    return prices, listings, macro


@pytest.mark.parametrize("day,want", [("2020-01-15", None), ("2020-02-01", 100.0), ("2020-03-01", 110.0)])
def test_get_sees_only_what_was_available(toy, day, want):
    rows = {r["symbol"]: r["close"] for r in pit.get(toy[0], day).collect()}
    assert rows.get("AAA") == want


def test_universe_keeps_delisted_symbols_while_they_lived(toy):
    days = Calendar.of([ts("2018-01-01"), ts("2020-02-01"), ts("2020-03-15"), ts("2020-03-20")])
    rows = pit.universe(toy[1], days).collect()
    alive = {d: sorted(r["symbol"] for r in rows if r["as_of"] == d) for d in days.dates}
    assert list(alive.values()) == [[], ["AAA", "BBB"], ["AAA"], ["AAA"]]


@pytest.mark.parametrize("day,want", [("2020-01-15", None), ("2020-02-20", 256.0), ("2020-03-11", 256.4), ("2020-03-12", 257.0)])
def test_macro_prefers_the_newest_period(toy, day, want):
    rows = [r["value"] for r in pit.macro(toy[2], day).collect()]
    assert rows == ([] if want is None else [want])


def test_strict_drops_approximate_rows(toy):
    assert pit.strict_only(toy[0]).count() == 3
    assert pit.strict_only(toy[0].drop("is_approximate")).count() == 4


def test_release_order_and_period_order_differ(spark):
    rows = spark.createDataFrame([("A", ts("2020-02-01"), ts("2020-03-01"), 2.0, False), ("A", ts("2020-01-01"), ts("2020-04-01"), 1.0, False)], PRICES)
    assert pit.get(rows, "2020-05-01").head()["close"] == 1.0
    series = rows.withColumnsRenamed({"symbol": "series", "close": "value"})
    assert pit.macro(series, "2020-05-01").head()["value"] == 2.0


def test_time_of_day_is_not_visible_at_midnight(spark):
    rows = spark.createDataFrame([("A", ts("2020-01-02 14:30:00"), ts("2020-01-02 14:30:00"), 1.0, False)], PRICES)
    days = Calendar.of([ts("2020-01-02"), ts("2020-01-03")])
    assert [r["as_of"] for r in asof.latest_asof(rows, days).collect()] == [ts("2020-01-03")]
    intraday = Calendar.of([ts("2020-01-02 14:00:00"), ts("2020-01-02 14:30:00"), ts("2020-01-02 15:00:00")])
    assert sorted(r["k"] for r in asof.latest_asof(rows, intraday).collect()) == [1, 2]


def test_missing_latest_price_drops_the_leg(spark):
    rows = [("A", ts(d), ts(d), c, False) for d, c in [("2020-01-31", 10.0), ("2020-02-29", float("nan")), ("2020-03-31", 12.0), ("2020-04-30", -1.0)]]
    days = Calendar.between("2020-01-01", "2020-05-31")
    legs = {r["k"]: r["leg"] for r in asof.price_legs(spark.createDataFrame(rows, PRICES), days).collect()}
    assert legs == {0: None, 1: None, 2: None, 3: None, 4: None}


def test_align_forward_fills_and_waits_for_release(spark):
    prices = spark.createDataFrame([("X", ts(d), ts(d), v, False) for d, v in [("2020-01-02", 10.0), ("2020-01-03", 11.0), ("2020-01-06", 12.0)]], PRICES)
    macro = spark.createDataFrame([("CPI", ts("2020-01-01"), ts("2020-01-05"), 256.0, False)], MACRO)
    days = Calendar.of([ts("2020-01-02"), ts("2020-01-03"), ts("2020-01-06")])
    wide = asof.align_wide(asof.align_panel(prices, macro, days), days, ["X", "CPI"]).orderBy("as_of").collect()
    assert [(r["X"], r["CPI"]) for r in wide] == [(10.0, None), (11.0, None), (12.0, 256.0)]


# -- against brute force on random panels with revisions, gaps and bad ticks ---


def random_panel(seed, n=160):
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        event = ts("2020-01-01") + timedelta(days=draw.randrange(0, 150, draw.choice([1, 10])))
        known = event + timedelta(days=draw.randrange(0, 90), hours=draw.choice([0, 0, 9]))
        close = draw.choice([float("nan"), draw.uniform(1, 9), draw.uniform(1, 9), draw.uniform(1, 9), draw.uniform(1, 9)])
        rows.append((draw.choice("AAAB"), event, known, close, False))
    return rows


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("last", [None, 1, 3, 8])
def test_history_matches_brute_force(spark, seed, last):
    rows = random_panel(seed)
    days = Calendar.between("2020-01-01", "2020-08-31")
    got = asof.history_asof(spark.createDataFrame(rows, PRICES), days, last=last).toPandas()
    frame = pd.DataFrame(rows, columns=PRICES.fieldNames())
    want = []
    for k, day in enumerate(days.dates):
        seen = frame[frame["available_date"] <= day].sort_values(["available_date", "close"])
        newest = seen.groupby(["symbol", "event_date"]).tail(1).dropna(subset=["close"]).sort_values("event_date")
        for symbol, part in newest.groupby("symbol"):
            part = part if last is None else part.tail(last)
            want += [(k, symbol, e, c) for e, c in zip(part["event_date"], part["close"])]
    assert sorted(got[["k", "symbol", "event_date", "close"]].itertuples(index=False, name=None)) == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_latest_matches_brute_force(spark, seed):
    rows = [r for r in random_panel(seed) if r[3] == r[3]]
    days = Calendar.between("2020-01-01", "2020-08-31")
    table = spark.createDataFrame(rows, PRICES)
    for order in (asof.BY_RELEASE, asof.BY_PERIOD):
        got = {(r["k"], r["symbol"]): r["close"] for r in asof.latest_asof(table, days, order=order).collect()}
        want = {}
        frame = pd.DataFrame(rows, columns=PRICES.fieldNames())
        for k, day in enumerate(days.dates):
            seen = frame[frame["available_date"] <= day].sort_values([*order, "close"])
            want.update({(k, s): c for s, c in seen.groupby("symbol")["close"].last().items()})
        assert got == want


def test_no_row_after_its_date_is_ever_read(spark):
    """Metamorphic: rows released later change nothing before their release."""
    rows = random_panel(11)
    days = Calendar.between("2020-01-01", "2020-05-31")
    later = [(s, e, ts("2020-07-01"), 999.0, False) for s, e, *_ in rows[:40]]
    def read(panel):
        return sorted(map(str, asof.history_asof(spark.createDataFrame(panel, PRICES), days).collect()))
    assert read(rows) == read(rows + later)


def test_last_rows_of_a_hot_symbol_stay_bounded(spark):
    """Many event dates first seen on one day: only the newest survive to the expansion."""
    base = ts("2020-01-01")
    rows = [("HOT", base + timedelta(minutes=i), ts("2020-02-01"), float(i), False) for i in range(3000)]
    days = Calendar.between("2020-01-01", "2020-04-30")
    kept = asof.history_asof(spark.createDataFrame(rows, PRICES), days, last=5, exact=False)
    assert kept.count() == 5 * 3
    assert kept.agg(F.min("close")).head()[0] == 2995.0
