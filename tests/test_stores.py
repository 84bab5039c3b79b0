"""Order and completeness of the stores: repeated ids, long boards, fold tables, sweeps over lookbacks."""

from datetime import datetime

import pytest
from pitspark.operators import calendars as c
from pitspark.operators import forecast as f
from pitspark.plans import reports
from pitspark.session import scratch_path, shared_folder
from pitspark.sources import runstore
from pyspark.sql import functions as F

METRICS = "array<struct<cumulative_return:double,annualized_return:double,annualized_vol:double,max_drawdown:double,sharpe:double,turnover:double,basis:string,segment:string>>"


def runs(spark, rows):
    """(run_id, strategy_name, sharpe) as records."""
    metrics = F.array(F.struct(*(F.lit(0.0).alias(n) for n in ("cumulative_return", "annualized_return", "annualized_vol", "max_drawdown")),
                               F.col("sharpe"), F.lit(0.0).alias("turnover"), F.lit("net").alias("basis"), F.lit("out_of_sample").alias("segment")))
    frame = spark.createDataFrame(rows, "run_id string, strategy_name string, sharpe double").coalesce(1)
    return frame.select("run_id", "strategy_name", F.create_map(F.lit("claim_boundary"), F.lit(runstore.CLAIM)).alias("strategy_metadata"),
                        F.create_map(F.lit("a"), F.lit("b")).alias("config"), metrics.cast(METRICS).alias("metrics"), F.lit(False).alias("is_baseline"))


def test_last_row_of_a_run_wins_within_and_across_writes(spark):
    path = scratch_path(spark, "runs")
    runstore.log_runs(runs(spark, [("a", "first", 1.0), ("a", "second", 2.0), ("b", "only", 1.0)]), path)
    got = {r.run_id: r.strategy_name for r in runstore.latest_runs(spark.read.parquet(path)).collect()}
    assert got == {"a": "second", "b": "only"}
    runstore.log_runs(runs(spark, [("a", "third", 0.5)]), path)
    got = {r.run_id: r.strategy_name for r in runstore.latest_runs(spark.read.parquet(path)).collect()}
    assert got == {"a": "third", "b": "only"}


def test_first_entry_of_an_experiment_stays(spark):
    path = scratch_path(spark, "registry")
    entries = [("fam", "strat", {"x": "1"}, [f"r{i}"], {"sharpe": float(i)}, ["t"], runstore.CLAIM) for i in range(5)]
    schema = "model_family string, strategy_name string, config map<string,string>, run_ids array<string>, metrics map<string,double>, tags array<string>, claim_boundary string"
    runstore.register(spark.createDataFrame(entries, schema), path)
    runstore.register(spark.createDataFrame(entries[3:], schema), path)
    rows = runstore.read_registry(spark, path).collect()
    assert [(r.run_ids, r.metrics) for r in rows] == [(["r0"], {"sharpe": 0.0})]


def test_summary_board_has_every_run(spark):
    many = runs(spark, [(f"r{i:04d}", "s", float(i % 97)) for i in range(250)])
    board = reports.summary_board(many)
    assert board.count() == 250 and {r.claim_boundary for r in board.collect()} == {runstore.CLAIM}
    summary = reports.run_summary(many).select("active_run_id", "rank").collect()
    assert sorted(r["rank"] for r in summary) == list(range(1, 251))


@pytest.mark.parametrize("plan", [c.WalkForward(6, 3, 3), c.WalkForward(1, 1, 1), c.WalkForward(12, 6, 1), c.WalkForward(500, 1, 1)])
def test_fold_table_is_the_fold_list(spark, plan):
    days = c.Calendar.between("2019-01-31", "2021-08-31", "monthly")
    frame = spark.createDataFrame([(d,) for d in days.dates], "as_of timestamp_ntz")
    want = {(n, "in_sample" if d < split else "out_of_sample", d) for n, start, split, stop in c.folds(days, plan) for d in days.dates if start <= d < stop}
    assert {(r.fold, r.segment, r.as_of) for r in c.fold_members(frame, plan).collect()} == want
    assert c.fold_members(frame.limit(0), plan).count() == 0


def test_next_dates(spark):
    frame = spark.createDataFrame([(datetime(2020, 1, d),) for d in (5, 1, 9)], "as_of timestamp_ntz")
    got = {r.as_of.day: r.next_as_of and r.next_as_of.day for r in c.next_dates(frame).collect()}
    assert got == {1: 5, 5: 9, 9: None}


def test_a_sweep_may_mix_lookbacks(spark):
    days = c.Calendar.between("2020-06-30", "2020-12-31", "quarterly")
    rows = [(k, s, datetime(2018 + m // 12, m % 12 + 1, 1), 100.0 + (m * 7 + len(s)) % 13) for k in range(len(days)) for s in ("A", "BB") for m in range(30)]
    history = spark.createDataFrame(rows, "k int, symbol string, event_date timestamp_ntz, close double")
    nets = [f.Network(lookback=3, hidden=2, epochs=3), f.Network(lookback=4, hidden=2, epochs=2), f.Network(lookback=3, hidden=1, epochs=2)]
    got, trace = f.forecast(history, ["A", "BB"], days, nets)
    for i, net in enumerate(nets):
        alone, _ = f.forecast(history, ["A", "BB"], days, [net])
        one = {(r.k, r.symbol): (round(r.expected_return, 9), r.status) for r in alone.collect()}
        assert {(r.k, r.symbol): (round(r.expected_return, 9), r.status) for r in got.filter(F.col("net") == i).collect()} == one
        assert trace.filter(F.col("net") == i).agg(F.max("epoch")).first()[0] == net.epochs - 1


def test_scratch_follows_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


class _Session:
    """As much of a session as says where scratch may go."""

    def __init__(self, master, warehouse, checkpoint=None):
        self.sparkContext, self.conf, self.master = self, self, master
        self.kept = {"spark.sql.warehouse.dir": warehouse, "spark.checkpoint.dir": checkpoint}

    def get(self, key, default=None):
        return self.kept[key] or default

    def getCheckpointDir(self):
        return None


def test_scratch_is_never_a_machines_own_disk_on_a_cluster():
    from pitspark.session import shared_folder
    assert shared_folder(_Session("local[4]", "file:/tmp/w")) == "file:/tmp/w/scratch"
    assert shared_folder(_Session("yarn", "hdfs://n/w")) == "hdfs://n/w/scratch"
    assert shared_folder(_Session("yarn", "file:/tmp/w", "hdfs://n/c/")) == "hdfs://n/c"
    for warehouse in ("file:/tmp/w", "/tmp/w"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_folder(_Session("spark://host:7077", warehouse))
