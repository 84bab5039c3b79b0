"""Reports that refuse to rank thin, oversampled or flat data."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import CADENCE_DAYS, OVERSAMPLE_TOLERANCE, cadence, oos_net
from ..operators import metrics as m
from ..operators.backtest import Backtest, Costs, run_backtest
from ..operators.calendars import Calendar, WalkForward, as_timestamp, ntz
from ..operators.universe import assess, episodes_in, sufficiency
from ..session import local_table, materialise
from ..sources.runstore import CLAIM
from .runs import as_records, leaderboard, ranked_rows

AUTHORITY = "out_of_sample_net_only"
REPORT = ("status string, claim_boundary string, metric_authority string, reason string, model_family string, strategy_name string, "
          "run_id string, oos_net_sharpe double, is_baseline boolean, rank int, window_start timestamp_ntz, window_end timestamp_ntz, "
          "episodes array<string>")


def insufficient_data(facts: DataFrame) -> DataFrame:
    """The sufficiency row as a report without rows."""
    return facts.filter("not sufficient").select(
        F.lit("insufficient_data").alias("status"), F.lit(CLAIM).alias("claim_boundary"), F.lit(AUTHORITY).alias("metric_authority"),
        "reason", "asset_count", "history_start", "history_end", "history_months", "min_assets", "min_months")


def _refused(spark, status: str, reason: str) -> DataFrame:
    row = (status, CLAIM, AUTHORITY, reason) + (None,) * 9
    return spark.createDataFrame([row], REPORT)


def oos_report(prices: DataFrame, weights: DataFrame, config: Backtest, *, baselines: Sequence[str],
               families: Mapping[str, str] | None = None, metadata: Mapping[str, Mapping[str, str]] | None = None,
               min_assets: int = 2, min_months: float = 18.0) -> DataFrame:
    """Compare the runs of a weights table out of sample, or say why not.

    The gate row and the flat guard are a few scalars and decide which plan runs
    next, so the driver reads them; everything else stays a table.
    """
    if config.mode != "net":
        raise ValueError("an out-of-sample comparison ranks net returns only")
    spark = prices.sparkSession
    facts = sufficiency(prices, min_assets, min_months).head()
    if not facts["sufficient"]:
        return _refused(spark, "insufficient_data", facts["reason"])
    rebalance_days = CADENCE_DAYS.get(config.rebalance, CADENCE_DAYS["monthly"])
    if facts["coarsest_days"] > rebalance_days * (1.0 + OVERSAMPLE_TOLERANCE):
        return _refused(spark, "oversampled", f"rebalanced every {rebalance_days} days, sampled every {facts['coarsest_days']}")
    # the backtest reads the weights three times: runs, legs and turnover
    weights = materialise(weights, "weights")
    _, metrics = run_backtest(weights, prices, config)
    # read twice below, and the whole backtest stands behind it
    metrics = materialise(metrics, "metrics")
    guard = m.flat_guard(metrics).head()
    if guard["max_oos_vol"] is None or guard["status"] != "computed":
        return _refused(spark, "degenerate", "flat out-of-sample returns")
    rows = ranked_rows(as_records(metrics, config, metadata or {}, baselines))
    known = {**{run: "baseline" for run in baselines}, **(families or {})}
    named = local_table(spark, list(known.items()), "run_id string, family string")
    start, end = config.calendar.dates[0], config.calendar.dates[-1]
    window = local_table(spark, [(start, end)], "start timestamp_ntz, end timestamp_ntz")
    episodes = [row["name"] for row in episodes_in(window).collect()]
    rows = rows.join(F.broadcast(named), "run_id", "left").withColumn("model_family", F.coalesce("family", "run_id"))
    return rows.select(
        F.lit("computed").alias("status"), F.lit(CLAIM).alias("claim_boundary"), F.lit(AUTHORITY).alias("metric_authority"),
        F.lit(None).cast("string").alias("reason"), "model_family", "strategy_name", "run_id", "oos_net_sharpe", "is_baseline", "rank",
        ntz(start).alias("window_start"), ntz(end).alias("window_end"),
        F.lit(",".join(episodes)).alias("e")).withColumn(
            "episodes", F.filter(F.split("e", ","), lambda x: x != "")).drop("e")


#: a strategy that is planned once the universe and the window are known
Strategy = Callable[[DataFrame, DataFrame, Calendar], DataFrame]


@dataclass(frozen=True)
class FamilyReport:
    """The ranked rows, one row of provenance, and the universe, all as tables."""

    rows: DataFrame
    provenance: DataFrame
    universe: DataFrame


def family_report(prices: DataFrame, baseline: Strategy, families: Mapping[str, Strategy], *, rebalance: str = "monthly", costs: Costs = Costs(),
                  walk_forward: WalkForward = WalkForward(36, 12, 12), window: tuple | None = None, min_assets: int = 2, min_months: float = 18.0,
                  metadata: Mapping[str, Mapping[str, str]] | None = None, availability_mode: str = "approximate_event_date") -> FamilyReport:
    """A baseline and families on one shared universe and one shared window.

    Which symbols and dates those are follows from the panel, so a strategy is a function of
    (prices of the universe, universe, calendar) that is called only after the gate; symbols
    outside the universe reach none of them. ``window`` replaces the shared one. Data that is
    too thin, sampled more coarsely than it is rebalanced, or flat gives a single row with the
    reason; the provenance is there all the same.
    """
    if not families:
        raise ValueError("a comparison needs at least one family")
    spark = prices.sparkSession
    facts, members = assess(prices, min_assets, min_months)
    facts, members = materialise(facts, "facts"), materialise(members, "universe")
    known = facts.head()
    days = CADENCE_DAYS.get(rebalance, CADENCE_DAYS["monthly"])
    start, end = window or (known["overlap_start"], known["overlap_end"])
    bounds = local_table(spark, [(start and as_timestamp(start), end and as_timestamp(end))], "start timestamp_ntz, end timestamp_ntz")
    covered = episodes_in(bounds).agg(F.array_sort(F.collect_set("name"))).scalar()
    provenance = facts.select(
        F.lit(availability_mode).alias("availability_mode"), "asset_count", "universe_size", "history_months", "overlap_start", "overlap_end", "overlap_months",
        ntz(start).alias("window_start") if start else F.lit(None).cast("timestamp_ntz").alias("window_start"),
        ntz(end).alias("window_end") if end else F.lit(None).cast("timestamp_ntz").alias("window_end"),
        "coarsest_days", cadence(F.col("coarsest_days")).alias("coarsest_cadence"), "homogeneous", F.lit(rebalance).alias("rebalance"),
        F.lit(round(days, 4)).alias("rebalance_days"), F.lit(float(costs.charged_bps)).alias("cost_bps"), covered.alias("cycles_covered"))

    def refused(status: str, reason: str) -> FamilyReport:
        return FamilyReport(_refused(spark, status, reason), provenance, members)

    if not known["sufficient"]:
        return refused("insufficient_data", known["reason"])
    if known["coarsest_days"] > days * (1.0 + OVERSAMPLE_TOLERANCE):
        return refused("oversampled", f"rebalanced every {days} days, sampled every {known['coarsest_days']}")
    calendar = Calendar.between(start, end, rebalance)
    inside = prices.join(members.select("symbol"), "symbol", "left_semi")
    names = members.select("symbol")
    table = _named_run(baseline(inside, names, calendar), "baseline")
    for family, build in families.items():
        table = table.unionByName(_named_run(build(inside, names, calendar), family))
    config = Backtest(calendar, rebalance, "net", costs, walk_forward)
    _, metrics = run_backtest(materialise(table, "weights"), inside, config)
    metrics = materialise(metrics, "metrics")
    guard = m.flat_guard(metrics).head()
    if guard["max_oos_vol"] is None or guard["status"] != "computed":
        return refused("degenerate", "flat out-of-sample returns")
    rows = ranked_rows(as_records(metrics, config, metadata or {}, ["baseline"]))
    return FamilyReport(rows.select(
        F.lit("computed").alias("status"), F.lit(CLAIM).alias("claim_boundary"), F.lit(AUTHORITY).alias("metric_authority"),
        F.lit(None).cast("string").alias("reason"), F.col("run_id").alias("model_family"), "strategy_name", "run_id", "oos_net_sharpe", "is_baseline", "rank",
        ntz(start).alias("window_start"), ntz(end).alias("window_end"), covered.alias("episodes")), provenance, members)


def _named_run(weights: DataFrame, run: str) -> DataFrame:
    return weights.select(F.lit(run).alias("run"), "k", "symbol", "weight")


def performance_report(returns: DataFrame, window: int = 12, periods_per_year: int = 12,
                       learning_curves: DataFrame | None = None) -> DataFrame:
    """One row per run with its paths; ``status`` names series too short, not finite or flat to report."""
    shape = m.distribution(returns, ["run"], m.population_sharpe(periods_per_year).alias("oos_net_sharpe"))
    rows = m.wealth_path(returns, ["run"])
    rolling = m.rolling_sharpe(returns, ["run"], window, periods_per_year).select("run", "k", "rolling_sharpe")
    points = F.sort_array(F.collect_list(F.struct("k", *[F.round(c, 10).alias(c) for c in ("wealth", "drawdown")])))
    paths = rows.groupBy("run").agg(points.alias("p")).select("run", F.col("p.wealth").alias("equity_curve"), F.col("p.drawdown").alias("drawdown"))
    sharpes = rolling.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("k", F.round("rolling_sharpe", 10).alias("v")))).alias("p"))
    out = shape.join(paths, "run").join(sharpes.select("run", F.col("p.v").alias("rolling_sharpe")), "run", "left")
    if learning_curves is not None:
        out = out.join(learning_curves, "run", "left")
    broken = F.isnan("mean") | (F.abs("mean") == float("inf"))
    status = (F.when(F.col("observations") < 2, "too_short").when(broken, "not_finite")
              .when(F.col("volatility") <= 1e-12, "flat").otherwise("ok"))
    for name in ("mean", "volatility", "skew", "excess_kurtosis", "var_5pct", "oos_net_sharpe"):
        out = out.withColumn(name, F.round(name, 10))
    return out.withColumn("status", status).withColumn("claim_boundary", F.lit(CLAIM))


def run_summary(runs: DataFrame, run_id: str | None = None, experiments: DataFrame | None = None) -> DataFrame:
    """A run with its regime, allocation, kept rebalance dates, out-of-sample metrics and place on the leaderboard.

    The board itself is a table, :func:`summary_board`, as long as there are runs.
    """
    active = runs if run_id is None else runs.filter(F.col("run_id") == run_id)
    about = F.col("strategy_metadata")
    label = F.coalesce(about["last_regime"], F.lit("unknown"))
    regime = F.struct(label.alias("label"), F.coalesce(F.try_to_number(about["last_regime_confidence"], F.lit("9.99")).cast("double"), F.lit(0.0)).alias("confidence"))
    rows = active.select(
        F.col("run_id").alias("active_run_id"), "strategy_name", F.coalesce(about["claim_boundary"], F.lit(CLAIM)).alias("claim_boundary"),
        regime.alias("regime"), F.from_json(F.coalesce(about["weights"], about["last_weights"]), "map<string,double>").alias("allocation"),
        F.from_json(about["rebalance_dates"], "array<string>").alias("rebalance_dates"), oos_net(F.col("metrics")).alias("oos_net_metrics"),
        F.when(about["last_regime"].isNull(), F.array(F.lit("missing_regime_metadata"))).otherwise(F.array().cast("array<string>")).alias("warnings"))
    out = rows.join(summary_board(runs).select(F.col("run_id").alias("active_run_id"), "rank"), "active_run_id", "left")
    if experiments is not None:
        known = experiments.select("experiment_id", "model_family", F.explode("run_ids").alias("active_run_id"))
        mine = known.groupBy("active_run_id").agg(F.sort_array(F.collect_list(F.struct("model_family", "experiment_id"))).alias("experiments"))
        out = out.join(mine, "active_run_id", "left")
    return out


def summary_board(runs: DataFrame) -> DataFrame:
    """The whole leaderboard, each row with its claim."""
    claims = runs.select("run_id", F.coalesce(F.col("strategy_metadata")["claim_boundary"], F.lit(CLAIM)).alias("claim_boundary"))
    return leaderboard(runs).join(claims, "run_id")
