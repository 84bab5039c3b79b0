"""The shapes of the plans that matter at scale."""

import re
from datetime import datetime

import pytest

from pitspark.operators import asof, forecast, ladder, pit
from pitspark.operators.calendars import Calendar
from pitspark.queries import QUERIES, load_all
from pitspark.schemas import PRICES

load_all()


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "prices")
    day = datetime(2020, 1, 31)
    spark.createDataFrame([("A", day, day, 1.0, False)], PRICES).write.parquet(path)
    return spark.read.schema(PRICES).parquet(path)


def test_availability_filter_and_columns_reach_the_files(stored):
    days = Calendar.between("2020-01-01", "2020-12-31")
    for frame in (pit.get(stored, "2020-06-30"), asof.latest_asof(stored, days)):
        plan = plan_of(frame)
        pushed = plan.split("PushedFilters: [")[1].split("]")[0]
        assert "LessThanOrEqual(available_date" in pushed
        schema = plan.split("ReadSchema: ")[1].splitlines()[0]
        assert "is_approximate" not in schema


def test_last_rows_are_limited_before_the_shuffle(stored):
    plan = plan_of(asof.history_asof(stored, Calendar.between("2020-01-01", "2020-12-31"), last=3))
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("last", [3])
def test_parts_follow_the_cells_that_unfold(stored, monkeypatch, last):
    days = Calendar.between("2020-01-01", "2020-12-31")
    rows = stored.unionByName(stored)
    for cells, parts in ((12, 2), (8, 3)):  # two rows on twelve dates
        monkeypatch.setattr(asof, "CELLS", cells)
        for frame in (asof.history_asof(rows, days, last=last, exact=False), asof.price_legs(rows, days)):
            assert f", {parts}), REPARTITION_BY_NUM" in plan_of(frame)


@pytest.mark.parametrize("name", ["b1_equal_weight_backtest", "b1_random_weight_backtest", "j7_weights_on_legs"])
def test_weights_of_every_date_are_not_broadcast(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "SortMergeJoin [symbol" in plan and "BroadcastHashJoin [symbol" not in plan


@pytest.mark.parametrize("name", ["j1_asof_latest", "j2_macro_latest", "j3_align_panel", "j4_history_every_date", "j5_universe", "w9_last_rows",
                                  "b1_equal_weight_backtest", "a10_return_risk", "m3_random_weights", "a14_cointegration", "p8_gap_slices"])
def test_no_nested_loops(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_results_do_not_depend_on_the_session_zone(spark, stored):
    days = Calendar.between("2020-01-01", "2020-03-31")
    before = spark.conf.get("spark.sql.session.timeZone")
    answers = []
    try:
        for zone in ("UTC", "America/New_York", "Asia/Taipei"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            answers.append((sorted(map(str, asof.latest_asof(stored, days).collect())), pit.get(stored, "2020-01-31").count()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert answers[0][1] == 1 and answers.count(answers[0]) == 3


def test_whole_periods_are_counted_without_a_table_of_symbols(spark, sf_dir):
    assert "distinct" not in plan_of(QUERIES["a9_all_suppliers"](spark, sf_dir)).lower()


def test_scales_take_one_pass_and_agree_with_the_levels(spark):
    plans = [(f"{f}|{n}", 1000.0, 90.0, p1, n, 0.01, f, u) for f in (-1.5, -1.0, 0.0, 0.5, 0.9999999, 1.0, 1.0000001, 1.1, 3.0, 1e5)
             for n, p1, u in ((1, 60.0, 1.0), (1, 0.0, 2.0), (7, 45.5, 1.0), (50, 0.0, 3.0))]
    frame = spark.createDataFrame(plans, "plan string, budget double, price_init double, price_final double, times int, min_increment double, param double, init_units double")
    for method in ladder.METHODS:
        found = ladder.scaled_plans(frame, method)
        assert "Join" not in plan_of(found) and "Exchange" not in plan_of(found)
        for (_, budget, p0, p1, n, _, f, u), row in zip(plans, found.collect(), strict=True):
            cost = sum((p0 - abs(p0 - p1) / n * i) * (u + f * (i - 1) if method == "arithmetic" else u * f ** (i - 1)) for i in range(1, n + 1))
            assert row["scale"] == (pytest.approx(budget / cost, rel=1e-11) if cost else None)


def test_both_scales_come_without_a_join(spark, sf_dir):
    assert "Join" not in plan_of(QUERIES["f15_budget_scale"](spark, sf_dir))


def test_whole_histories_are_dealt_before_they_unfold(stored):
    history = asof.history_asof(stored, Calendar.between("2020-01-01", "2020-12-31"))
    plan = plan_of(forecast.windows(history, 6))
    assert not re.search(r"hashpartitioning\(symbol#\d+, k#", plan)
    assert len(re.findall(r"Sort \[symbol#\d+ ASC NULLS FIRST, k#\d+ ASC NULLS FIRST, event_date", plan)) == 1
