"""Families on one universe and window: what strategies see, refusals and provenance."""

from datetime import datetime

import pytest

from pitspark.operators import weights as w
from pitspark.operators.calendars import WalkForward
from pitspark.plans.reports import family_report
from pitspark.schemas import PRICES


def _panel(spark, spans, flat=False):
    rows = []
    for symbol, (first, last) in spans.items():
        for i in range(first, last):
            day = datetime(2010 + i // 12, i % 12 + 1, 1)
            rows.append((symbol, day, day, 100.0 if flat else 100.0 + i + 7 * (i * len(symbol) % 5) + ord(symbol[0]) % 3 * (i % 4), False))
    return spark.createDataFrame(rows, PRICES)


def _equal(prices, universe, calendar):
    return w.equal_weight(universe, calendar)


SPANS = {"A": (0, 70), "B": (3, 66), "C": (2, 72), "LATE": (60, 72), "EARLY": (0, 12)}


def test_strategies_are_planned_on_the_universe_alone(spark):
    asked = []

    def spy(prices, universe, calendar):
        asked.append(({r["symbol"] for r in prices.select("symbol").distinct().collect()}, {r["symbol"] for r in universe.collect()}, calendar))
        return w.sma_timing(prices, universe, calendar, window=3)

    report = family_report(_panel(spark, SPANS), _equal, {"timing": spy}, walk_forward=WalkForward(24, 6, 6), min_months=24)
    prices, universe, calendar = asked[0]
    assert prices == universe == {"A", "B", "C"} and len(asked) == 1
    assert calendar.dates[0] == datetime(2010, 4, 30) and calendar.dates[-1] <= datetime(2015, 6, 1)
    rows = {r["model_family"]: r for r in report.rows.collect()}
    assert set(rows) == {"baseline", "timing"} and rows["baseline"]["is_baseline"] and {r["status"] for r in rows.values()} == {"computed"}
    facts = report.provenance.collect()
    assert len(facts) == 1 and facts[0]["universe_size"] == 3 and facts[0]["asset_count"] == 5 and facts[0]["overlap_start"] == datetime(2010, 4, 1)
    assert {r["symbol"] for r in report.universe.collect()} == {"A", "B", "C"}


@pytest.mark.parametrize("spans, flat, rebalance, status", [
    ({"A": (0, 70)}, False, "monthly", "insufficient_data"), ({"A": (0, 30), "B": (40, 70)}, False, "monthly", "insufficient_data"),
    (SPANS, True, "monthly", "degenerate")])
def test_refusals_keep_their_provenance(spark, spans, flat, rebalance, status):
    report = family_report(_panel(spark, spans, flat), _equal, {"same": _equal}, rebalance=rebalance, walk_forward=WalkForward(24, 6, 6), min_months=24)
    assert [r["status"] for r in report.rows.collect()] == [status]
    assert report.provenance.count() == 1


def test_a_window_of_ones_own_and_no_family(spark):
    panel = _panel(spark, SPANS)
    report = family_report(panel, _equal, {"same": _equal}, window=("2011-01-01", "2014-12-31"), walk_forward=WalkForward(24, 6, 6), min_months=24)
    row = report.rows.filter("is_baseline").collect()[0]
    assert (row["window_start"], row["window_end"]) == (datetime(2011, 1, 1), datetime(2014, 12, 31))
    with pytest.raises(ValueError, match="family"):
        family_report(panel, _equal, {})
