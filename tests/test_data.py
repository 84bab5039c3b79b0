"""Payloads, stores, contracts, ladders, registry and streams on small landed files."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pitspark.operators import ladder, quality
from pitspark.plans import runs
from pitspark.schemas import ALT_CONTRACT, CHART, METRIC, SNAPSHOT, SOURCE_HEALTH
from pitspark.functions.columns import last_chart_date, last_csv_date, round_to_step
from pitspark.sources import altdata, reports, runstore, snapshots, vintage
from pitspark.streaming import ingest


def ts(text):
    return datetime.fromisoformat(text)


def record(source, available, raw, **more):
    return {"source": source, "available_date": available, "is_approximate": False, "captured_at": "t", "raw": raw, **more}


CHART_RAW = json.dumps({"chart": {"result": [{"timestamp": [1780963200, 1781049600, 1781136000], "indicators": {
    "quote": [{"close": [1000.0, None]}]}}], "error": None}})


@pytest.fixture()
def landing(tmp_path):
    files = {
        "2026-06-05/fred_CPI.json": record("fred:CPIAUCSL", "2026-06-05", "observation_date,CPIAUCSL\n2026-01-01,256.0\n2026-02-01,.\n2026-03-01,\nbroken\n2026-04-01,abc\n"),
        "2026-06-06/fred_CPI.json": record("fred:CPIAUCSL", "2026-06-06", "observation_date,CPIAUCSL\n2026-01-01,256.4\n", is_approximate=True),
        "2026-06-06/fred_SP.json": record("fred:SP500", "2026-06-06", "observation_date,SP500\n2026-06-05,5000\n"),
        "2026-06-06/deep/stooq.json": record("stooq:spy.us", "2026-06-06", "Symbol,Date,Time,Open,High,Low,Close,Volume\nSPY.US,2026-06-06,22:00:00,1,2,0.5,1.5,1000\nSPY.US,2026-06-07,x\nSPY.US,2026-06-08,0,0,0,0,N/D,0\n"),
        "2026-06-06/stooq_bad.json": record("stooq:bad", "2026-06-06", "Symbol,Close\nA,1\n"),
        "2026-06-06/yahoo.json": record("yahoo:2330.TW", "2026-06-11", CHART_RAW),
        "2026-06-06/noaa.json": record("noaa:oni", "2026-06-06", "SEAS YR\n"),
        "2026-06-06/nothing.json": record("fred:X", None, "a,b\n1,2\n"),
    }
    for name, body in files.items():
        path = tmp_path / "raw" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(body, indent=2))
    return str(tmp_path / "raw")


def test_loader_routes_every_source(spark, landing):
    prices, macro, listings = vintage.load_panel(vintage.read_snapshots(spark, landing), {"SP500"})
    got = {(r["symbol"], str(r["event_date"]), r["close"]) for r in prices.collect()}
    assert got == {("SP500", "2026-06-05 00:00:00", 5000.0), ("SPY.US", "2026-06-06 00:00:00", 1.5), ("2330.TW", "2026-06-09 00:00:00", 1000.0)}
    assert sorted((r["series"], r["value"], str(r["available_date"])[:10]) for r in macro.collect()) == [
        ("CPIAUCSL", 256.0, "2026-06-05"), ("CPIAUCSL", 256.4, "2026-06-06")]
    assert listings.count() == 3 and listings.filter("delist_date is not null").isEmpty()
    _, strict, _ = vintage.load_panel(vintage.read_snapshots(spark, landing), strict=True)
    assert strict.filter("value = 256.4").isEmpty()
    loose, _, _ = vintage.load_panel(vintage.read_snapshots(spark, landing), approximate=True)
    assert loose.filter("available_date <> event_date").isEmpty()


def test_last_event_dates(spark):
    rows = spark.createDataFrame([("d,v\n2026-01-01,1\n2026-02-01,2\n\n",), ("d,v\n",)], "raw string")
    assert [r["x"] for r in rows.select(last_csv_date(F.col("raw")).alias("x")).collect()] == ["2026-02-01", None]
    chart = spark.createDataFrame([(CHART_RAW,), ('{"chart":{"result":[]}}',)], "raw string")
    assert [r["x"] for r in chart.select(last_chart_date(F.col("raw"), CHART).alias("x")).collect()] == ["2026-06-09", None]


def rows_of(spark, rows):
    names = SNAPSHOT.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SNAPSHOT)


def test_first_write_wins(spark, tmp_path):
    store = str(tmp_path / "store")
    snapshots.write_snapshots(rows_of(spark, [record("fred:A", "2026-01-01", "one")]), store)
    second = rows_of(spark, [record("fred:A", "2026-01-01", "two"), record("fred:B", "2026-01-01", "three")])
    assert {(r["source"], r["status"]) for r in snapshots.outcomes(second, snapshots.read_store(spark, store)).collect()} == {("fred:A", "skip"), ("fred:B", "ok")}
    snapshots.write_snapshots(second, store)
    assert {(r["source"], r["raw"]) for r in snapshots.read_store(spark, store).collect()} == {("fred:A", "one"), ("fred:B", "three")}


def test_gap_slice_keeps_the_window_up_to_the_day(spark):
    obs = spark.createDataFrame([("fred:X", ts(d), 1.0, ts("2026-08-01")) for d in ("2026-06-10", "2026-06-15", "2026-07-01", "2026-07-20")],
                                "source string, event_date timestamp_ntz, value double, available_date timestamp_ntz")
    days = spark.createDataFrame([("2026-06-15",), ("2026-07-02",)], "day string")
    out = {str(r["day"]): [str(x["event_date"])[:10] for x in r["rows"]] for r in vintage.gap_slices(obs, days, "2026-06-13").collect()}
    assert out == {"2026-06-15": ["2026-06-15"], "2026-07-02": ["2026-06-15", "2026-07-01"]}


def contracts(spark, status="available", extra=()):
    return spark.createDataFrame([("policy", "news", "https://example.test", "v1", False, status, altdata.BOUNDARY), *extra], ALT_CONTRACT)


def test_alt_data_contracts(spark, tmp_path):
    path = tmp_path / "alt.csv"
    path.write_text("event_date,available_date,value,is_approximate\n2026-01-01,2026-01-02,1.5,Yes\n2026-01-08,2026-01-09,2.5,\n")
    rows = altdata.read_csv(spark, str(path), ("policy", "news"), contracts(spark), "2026-01-05").collect()
    assert [(r["event_date"], r["value"], r["is_approximate"]) for r in rows] == [("2026-01-01", 1.5, True)]
    with pytest.raises(Exception, match="not ready"):
        altdata.read_csv(spark, str(path), ("policy", "news"), contracts(spark, "unknown"), "2026-01-05").collect()
    assert altdata.read_csv(spark, str(path), ("policy", "news"), contracts(spark, "unknown"), "2026-01-05", strict=False).count() == 1
    with pytest.raises(Exception, match="missing source contract"):
        altdata.read_csv(spark, str(path), ("other", "news"), contracts(spark), "2026-01-05").collect()
    twice = contracts(spark, extra=[("policy", "news", "https://example.test", "v2", False, "available", altdata.BOUNDARY)])
    with pytest.raises(Exception, match="duplicate contract"):
        altdata.read_csv(spark, str(path), ("policy", "news"), twice, "2026-01-05").collect()


PLAN = "plan string, budget double, price_init double, price_final double, times int, min_increment double, param double, init_units double"


def test_ladder_levels_and_budget(spark):
    plans = spark.createDataFrame([("p", 100000.0, 100.0, 50.0, 10, 1.0, 2.0, 1.0)], PLAN)
    levels = ladder.ladder(plans).orderBy("level").collect()
    assert [r["price"] for r in levels] == [95.0, 90.0, 85.0, 80.0, 75.0, 70.0, 65.0, 60.0, 55.0, 50.0]
    cost = sum((100 - 5 * i) * (1 + 2 * (i - 1)) for i in range(1, 11))
    assert [r["units"] for r in levels] == [round((1 + 2 * i) * 100000 / cost) for i in range(10)]
    total = ladder.totals(ladder.ladder(plans), plans).head()
    assert total["total_amount"] == pytest.approx(sum(r["amount"] for r in levels))
    assert total["drop_pct"] == 50.0 and levels[-1]["cumulative_pct"] == pytest.approx(100.0)
    shares = [r["units"] for r in ladder.unit_ladder(plans.withColumn("param", F.lit(1.5)), "geometric").orderBy("level").collect()]
    assert shares == pytest.approx([1.5 ** i for i in range(10)])
    with pytest.raises(ValueError):
        ladder.ladder(plans, "harmonic")


def test_rounding_follows_the_digits_of_the_step(spark):
    rows = spark.createDataFrame([(0.4, 1.0), (2.5, 1.0), (3.5, 1.0), (7.3, 5.0), (14.0, 10.0), (0.12345, 0.001), (3.0, 5.0)], "u double, s double")
    got = [r["x"] for r in rows.select(round_to_step(F.col("u"), F.col("s")).alias("x")).collect()]
    assert got == pytest.approx([1.0, 2.0, 4.0, 7.0, 10.0, 0.123, 5.0])


def test_zero_budget_buys_nothing(spark):
    weights = spark.createDataFrame([("A", 1.0), ("B", 0.0)], "symbol string, weight double")
    plans = spark.createDataFrame([("A", 100.0, 50.0, 5, 1.0, 1.0, 1.0)], "symbol string, price_init double, price_final double, times int, min_increment double, param double, init_units double")
    budgets, levels = ladder.allocate(weights, plans, 1000.0)
    assert {r["symbol"]: r["budget"] for r in budgets.collect()} == {"A": 1000.0, "B": 0.0}
    assert {r["plan"] for r in levels.collect()} == {"A"}


def metric(sharpe, segment="out_of_sample"):
    return (0.1, 0.1, 0.1, -0.1, sharpe, 1.0, "net", segment)


RUN_SCHEMA = "run_id string, strategy_name string, strategy_metadata map<string,string>, config map<string,string>, is_baseline boolean"


def run_rows(spark, rows):
    from pyspark.sql import types as T
    schema = T.StructType(T._parse_datatype_string(RUN_SCHEMA).fields + [T.StructField("metrics", T.ArrayType(METRIC))])
    return spark.createDataFrame(rows, schema)


def test_leaderboard_orders_and_refuses(spark):
    table = run_rows(spark, [("a", "A", {}, {}, False, [metric(0.5), metric(9.0, "in_sample")]), ("b", "B", {}, {}, True, [metric(1.5)]), ("c", "C", {}, {}, False, [metric(3.0, "full")])])
    assert [r["run_id"] for r in runs.leaderboard(table).collect()] == ["b", "a", "c"]
    assert [r["run_id"] for r in runs.leaderboard(table, descending=False).collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        runs.leaderboard(table, "in_sample_sharpe")
    bad = run_rows(spark, [("x", "X", {"claim_boundary": "alpha"}, {}, False, [metric(1.0)])])
    with pytest.raises(Exception, match="overclaiming"):
        runs.ranked_rows(bad).collect()
    families = spark.createDataFrame([("f", ["a"])], "model_family string, run_ids array<string>")
    with pytest.raises(Exception, match="visible baseline"):
        runs.family_evaluation(runs.family_scores(table, families)).collect()


def test_run_log_replaces_by_id_and_generates_ids(spark, tmp_path):
    path = str(tmp_path / "runs")
    runstore.log_runs(run_rows(spark, [("a", "old", {}, {}, False, [metric(0.5)]), (None, "anon", {}, {}, False, [metric(0.1)])]), path)
    runstore.log_runs(run_rows(spark, [("a", "new", {}, {}, False, [metric(0.7)])]), path)
    stored = runstore.latest_runs(spark.read.parquet(path))
    assert sorted(r["strategy_name"] for r in stored.collect()) == ["anon", "new"]
    assert runstore.get_run(stored, "a").head()["oos_net_sharpe"] == 0.7
    with pytest.raises(KeyError):
        runstore.get_run(stored, "nope")
    with pytest.raises(Exception, match="finite"):
        runstore.log_runs(run_rows(spark, [("n", "n", {}, {}, False, [metric(float("nan"))])]), path)


def test_registry_appends_once(spark, tmp_path):
    path = str(tmp_path / "registry")
    entry = ("fam", "strat", {"b": "2", "a": "1"}, ["r"], {"sharpe": 1.0}, "no_alpha_claim", ["t"])
    schema = "model_family string, strategy_name string, config map<string,string>, run_ids array<string>, metrics map<string,double>, claim_boundary string, tags array<string>"
    swapped = ("fam ", "strat", {"a": "1", "b": "2"}, ["r2"], {"sharpe": 2.0}, "no_alpha_claim", ["t"])
    runstore.register(spark.createDataFrame([entry], schema), path)
    runstore.register(spark.createDataFrame([swapped], schema), path)
    rows = runstore.read_registry(spark, path).collect()
    assert len(rows) == 1 and len(rows[0]["experiment_id"]) == 16 and rows[0]["run_ids"] == ["r"]
    with pytest.raises(Exception, match="carry the claim"):
        runstore.register(spark.createDataFrame([entry[:5] + ("alpha", ["t"])], schema), path)


def test_reports_are_checked_before_they_are_written(spark, tmp_path):
    good = spark.createDataFrame([("computed", "no_alpha_claim", 1.0)], "status string, claim_boundary string, v double")
    reports.write_report(good, str(tmp_path / "ok"))
    assert spark.read.json(str(tmp_path / "ok")).count() == 1
    with pytest.raises(Exception, match="invalid report row"):
        reports.write_report(good.withColumn("claim_boundary", F.lit("alpha")), str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        reports.write_report(good.drop("status"), str(tmp_path / "bad2"))


def test_source_health_keeps_arrival_order(spark):
    rows = [(1, "fred", "CPI", "available", True, ""), (2, "Stooq ", "*", "unknown", True, ""), (3, "stooq", "*", "blocked", False, "404"), (4, "fred", "GDP", "available", True, "ok")]
    got = {r["source"]: r for r in quality.source_health(spark.createDataFrame(rows, SOURCE_HEALTH)).collect()}
    names = quality.source_symbols(spark.createDataFrame(rows, SOURCE_HEALTH)).filter("source = 'fred'").orderBy("first").collect()
    assert [r["symbol"] for r in names] == ["CPI", "GDP"] and got["fred"]["reason"] == "ok" and got["fred"]["symbols"] == 2
    assert (got["stooq"]["status"], got["stooq"]["default_enabled"]) == ("blocked", False)


def test_snapshot_gate_and_quorum(spark):
    ids = [s for group in quality.REQUIRED_GROUPS.values() for s in group[:1]]
    jobs = spark.createDataFrame([("good", s, "ok") for s in ids] + [("bad", s, "ok") for s in ids] + [("bad", "fred:X", "fail"), ("thin", ids[0], "skip")], "run string, source_id string, status string")
    assert {r["run"]: r["verdict"] for r in quality.snapshot_gate(jobs).collect()} == {"good": "clean", "bad": "failed_sources", "thin": "clean"}
    assert {r["run"]: r["verdict"] for r in quality.snapshot_gate(jobs, allow_failures=True).collect()}["bad"] == "partial"
    claims = spark.createDataFrame([("good", 9, 0, 0, 0)], "run string, ok long, skip long, fail long, dry long")
    assert {r["verdict"] for r in quality.snapshot_gate(jobs, claims).collect()} == {"counts_do_not_match"}
    covered = {(r["run"], r["covered"]) for r in quality.source_quorum(jobs).groupBy("run").agg(F.bool_and("covered").alias("covered")).collect()}
    assert covered == {("good", True), ("bad", False), ("thin", False)}


def test_latest_quote_of_each_file(spark):
    jobs = spark.createDataFrame([("2026-01-01", f"stooq:{s}", st) for s, st in [("a", "ok"), ("b", "ok"), ("c", "fail"), ("d", "ok"), ("e", "skip")]], "available_date string, source_id string, status string")
    head = "Symbol,Date,Close\n"
    stored = rows_of(spark, [record("stooq:a", "2026-01-01", head + "A,2025-12-30,1\nA,2025-12-31,2\n"), record("stooq:b", "2026-01-01", head + "B,2025-12-31,N/D\n"), record("stooq:d", "2026-01-01", head)])
    got = {r["symbol"]: (r["event_date"], r["close"], r["reason"]) for r in quality.latest_close_rows(jobs, stored).collect()}
    assert got == {"a": ("2025-12-31", 2.0, None), "b": (None, None, "close must be positive"), "c": (None, None, "status fail"),
                   "d": (None, None, "no data rows"), "e": (None, None, "missing snapshot")}


def test_stream_restarts_do_not_write_twice(spark, tmp_path, landing):
    store, progress = str(tmp_path / "s"), str(tmp_path / "p")
    for _ in range(2):
        ingest.ingest_snapshots(ingest.stream_snapshots(spark, landing).filter("available_date is not null"), store, progress)
    first = snapshots.read_store(spark, store).count()
    ingest.ingest_snapshots(ingest.stream_snapshots(spark, landing).filter("available_date is not null"), store, str(tmp_path / "fresh"))
    assert snapshots.read_store(spark, store).count() == first == 7
