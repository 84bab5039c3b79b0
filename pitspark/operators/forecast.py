"""A small learned forecaster, trained on every date at once.

Training is full-batch gradient descent on one hidden tanh layer. Fitted networks are a
table keyed by (net, date), and nothing of it passes through the driver. Where a date's
windows fit a task, they meet there once for some networks and all epochs are run in that
pass. Larger dates stay in blocks: an epoch is a sum of gradients over blocks, joined to the
weights of the epoch before, which are again a table, written after every epoch.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import local_table, materialise
from .asof import period_returns
from .calendars import Calendar

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: windows of a date that one task trains on
TOGETHER = 200_000
#: windows of a block of a larger date
BLOCK = 50_000
#: networks that a task trains on the windows it was given
NETS_EACH = 4
FITTED = "net int, k int, weights array<double>, losses array<double>"


@dataclass(frozen=True)
class Network:
    lookback: int = 6
    hidden: int = 4
    epochs: int = 30
    seed: int = 0
    min_obs: int = 24
    rate: float = 0.1

    @property
    def size(self) -> int:
        return self.hidden * (self.lookback + 2) + 1

    def start(self) -> np.ndarray:
        """Seeded first weights, the same for every date."""
        draw = np.random.default_rng(self.seed)
        inner = draw.standard_normal((self.lookback, self.hidden)) * 0.1
        outer = draw.standard_normal((self.hidden, 1)) * 0.1
        return np.concatenate([inner.ravel(), np.zeros(self.hidden), outer.ravel(), np.zeros(1)])

    def layers(self, flat: np.ndarray):
        a, h = self.lookback * self.hidden, self.hidden
        return flat[:a].reshape(self.lookback, h), flat[a:a + h], flat[a + h:a + 2 * h], flat[-1]

    def predict(self, flat: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner, bias, outer, shift = self.layers(flat)
        layer = np.tanh(x @ inner + bias)
        return layer @ outer + shift, layer

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sums over the rows of the squared error and of its slope by weight."""
        guess, layer = self.predict(flat, x)
        miss = guess - y
        back = 2.0 * miss[:, None] * self.layers(flat)[2] * (1.0 - layer ** 2)
        return np.concatenate([(x.T @ back).ravel(), back.sum(0), 2.0 * layer.T @ miss, [2.0 * miss.sum(), (miss ** 2).sum()]])


def windows(history: DataFrame, lookback: int) -> DataFrame:
    """(k, symbol, event_date, x, y): each run of ``lookback`` returns and the return after it."""
    rets = period_returns(history)
    # newest first, as the returns come: no second sort
    before = Window.partitionBy("symbol", "k").orderBy(F.desc("event_date")).rowsBetween(1, lookback)
    rows = rets.select("k", "symbol", "event_date", F.reverse(F.collect_list("ret").over(before)).alias("x"), F.col("ret").alias("y"))
    return rows.filter(F.size("x") == lookback)


def newest_windows(rows: DataFrame) -> DataFrame:
    """(k, symbol, x): the last returns of each symbol, from its newest training row.

    That row's inputs without their oldest return, plus its target; a symbol with no
    training row has no full window and target.
    """
    newest = rows.groupBy("k", "symbol").agg(F.max(F.struct("event_date", "x", "y")).alias("r"))
    return newest.select("k", "symbol", F.concat(F.slice("r.x", 2, F.size("r.x") - 1), F.array("r.y")).alias("x"))


def _scales(rows: DataFrame, lookback: int) -> DataFrame:
    """Per date: row count and the mean and deviation of each input and of the target."""
    columns = [F.get("x", F.lit(i)) for i in range(lookback)] + [F.col("y")]
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in columns]).alias("mean"),
                                 F.array(*[F.stddev_pop(c) for c in columns]).alias("std"))


def _standard(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    return (x - mean[:-1]) / np.where(std[:-1] > 1e-12, std[:-1], 1.0)


def _inputs(frame: pd.DataFrame, mean: np.ndarray, std: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _standard(np.stack(frame["x"].to_numpy()), mean, std), (frame["y"].to_numpy() - mean[-1]) / std[-1]


def train(rows: DataFrame, nets: Sequence[Network], together: int = TOGETHER) -> DataFrame:
    """(net, k, n, mean, std, weights, losses): every network fitted on every date with enough windows.

    ``rows`` come from :func:`windows` for the nets' common lookback, best as a written
    table. ``losses`` holds each epoch's loss before its step. A date of more than
    ``together`` windows is trained in blocks, with the same result up to rounding.
    """
    lookback = nets[0].lookback
    if any(n.lookback != lookback for n in nets):
        raise ValueError("networks trained together share a lookback")
    table = rows.select("k", "x", "y")
    scales = materialise(_scales(table, lookback).filter(F.element_at("std", -1) > 1e-12), "scales")
    fitted = _train_whole(table, scales.filter(F.col("n") <= together), list(nets))
    large = scales.filter(F.col("n") > together)
    if not large.isEmpty():
        fitted = fitted.unionByName(_train_blocks(table, large, list(nets)))
    return fitted.join(scales, "k").select("net", "k", "n", "mean", "std", "weights", "losses")


def _train_whole(table: DataFrame, scales: DataFrame, nets: list[Network]) -> DataFrame:
    """All epochs in one pass, some networks of a date in a task."""
    groups = -(-len(nets) // NETS_EACH)

    def run(key, frame):
        group, k = key
        mean, std = (np.array(frame[c].iloc[0]) for c in ("mean", "std"))
        x, y = _inputs(frame, mean, std)
        out = []
        for i, net in list(enumerate(nets))[int(group)::groups]:
            if len(y) < net.min_obs:
                continue
            weights, losses = net.start(), []
            for _ in range(net.epochs):
                slope = net.gradient(weights, x, y) / len(y)
                losses.append(slope[-1])
                weights = weights - net.rate * slope[:-1]
            out.append((i, int(k), weights, losses))
        return pd.DataFrame(out, columns=["net", "k", "weights", "losses"])

    least = min(n.min_obs for n in nets)
    spread = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("nets")
    met = table.join(scales.filter(F.col("n") >= least), "k").select(spread, "k", "x", "y", "mean", "std")
    return met.groupBy("nets", "k").applyInPandas(run, FITTED)


def _train_blocks(table: DataFrame, scales: DataFrame, nets: list[Network]) -> DataFrame:
    """An epoch at a time: gradients of blocks, summed place by place, move the weights of the epoch before."""
    spark = table.sparkSession
    parts = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    dealt = table.join(scales.select("k", parts.alias("parts")), "k").withColumn("part", F.pmod(F.xxhash64("x", "y", F.monotonically_increasing_id()), F.col("parts")))
    packed = dealt.groupBy("k", "part").agg(F.collect_list(F.struct("x", "y")).alias("rows"))
    blocks = materialise(packed, "blocks")
    start = local_table(spark, [(i, n.min_obs, float(n.rate), n.epochs, ",".join(map(repr, n.start().tolist()))) for i, n in enumerate(nets)],
                        "net int, min_obs int, rate double, epochs int, start string")
    fresh = F.split("start", ",").cast("array<double>")
    state = scales.select("k", "n", "mean", "std").join(start, F.col("n") >= F.col("min_obs")).select(
        "net", "k", "n", "mean", "std", "rate", "epochs", fresh.alias("weights"), F.array().cast("array<double>").alias("losses"))
    state = materialise(state, "weights")

    def partial(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                frame = pd.DataFrame(list(row.rows))
                slope = nets[row.net].gradient(np.array(row.weights), *_inputs(frame, np.array(row.mean), np.array(row.std)))
                out += [(row.net, row.k, j, float(v)) for j, v in enumerate(slope)]
            yield pd.DataFrame(out, columns=["net", "k", "j", "v"])

    for epoch in range(max(n.epochs for n in nets)):
        live = state.filter(F.col("epochs") > epoch)
        cells = blocks.join(live.select("net", "k", "weights", "mean", "std"), "k").mapInPandas(partial, "net int, k int, j int, v double")
        summed = cells.groupBy("net", "k", "j").agg(F.sum("v").alias("v")).groupBy("net", "k").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("g"))
        slope = F.transform("g", lambda p: p["v"] / F.col("n"))
        moved = state.join(summed, ["net", "k"], "left").withColumn("slope", slope)
        step = F.transform("weights", lambda w, i: w - F.col("rate") * F.get("slope", i))
        state = materialise(moved.select(
            "net", "k", "n", "mean", "std", "rate", "epochs", F.when(F.col("slope").isNull(), F.col("weights")).otherwise(step).alias("weights"),
            F.when(F.col("slope").isNull(), F.col("losses")).otherwise(F.concat("losses", F.array(F.element_at("slope", -1)))).alias("losses")), "weights")
    return state.select("net", "k", "weights", "losses")


def forecast(history: DataFrame, symbols: Sequence[str], calendar: Calendar, nets: Sequence[Network]) -> tuple[DataFrame, DataFrame]:
    """((net, k, symbol, expected_return, status), (net, k, epoch, loss)).

    Networks of one lookback train together, on the windows of that length; ``net`` is the place
    in ``nets``. A date is degraded for all its symbols when its windows are too few or flat or
    one symbol has no full window and target.
    """
    groups: dict[int, list[int]] = {}
    for i, net in enumerate(nets):
        groups.setdefault(net.lookback, []).append(i)
    parts = []
    for places in groups.values():
        found = _forecast_together(history, symbols, calendar, [nets[i] for i in places])
        place = F.get(F.array(*map(F.lit, places)), F.col("net"))
        parts.append(tuple(df.withColumn("net", place) for df in found))
    rows, trace = parts[0]
    for more, further in parts[1:]:
        rows, trace = rows.unionByName(more), trace.unionByName(further)
    return rows, trace


def _guess(nets: Sequence[Network]) -> Column:
    """The network's answer to ``x``, by its place ``net``, in column expressions."""
    scaled = F.transform("x", lambda v, i: (v - F.get("mean", i)) / F.when(F.get("std", i) > 1e-12, F.get("std", i)).otherwise(1.0))

    def answer(net: Network) -> Column:
        inner, hidden = net.lookback * net.hidden, net.hidden
        total = F.get("weights", F.lit(net.size - 1))
        for h in range(hidden):
            own = F.filter("weights", lambda _, i: (i < inner) & (i % hidden == h))  # one weight per input
            terms = F.zip_with(scaled, own, lambda v, w: v * w)
            layer = F.tanh(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) + F.get("weights", F.lit(inner + h)))
            total = total + layer * F.get("weights", F.lit(inner + hidden + h))
        return total * F.element_at("std", -1) + F.element_at("mean", -1)

    found = F.lit(None).cast("double")
    for i, net in enumerate(nets):
        found = F.when(F.col("net") == i, answer(net)).otherwise(found)
    return found


def _forecast_together(history: DataFrame, symbols: Sequence[str], calendar: Calendar, nets: Sequence[Network]) -> tuple[DataFrame, DataFrame]:
    spark, lookback = history.sparkSession, nets[0].lookback
    mine = history.filter(F.col("symbol").isin(list(symbols)))
    # scales, training and the newest windows read it; a written table survives lost executors
    table = materialise(windows(mine, lookback), "windows")
    fitted = materialise(train(table, nets), "fitted")
    newest = newest_windows(table)
    whole = newest.groupBy("k").agg((F.count("*") == len(set(symbols))).alias("whole"))
    full = newest.join(whole.filter("whole"), "k", "left_semi").select("k", "symbol", "x")
    guessed = full.join(fitted, "k").select("net", "k", "symbol", _guess(nets).alias("value"))
    grid = local_table(spark, [(s,) for s in symbols], "symbol string").withColumn(
        "k", F.explode(F.sequence(F.lit(0), F.lit(len(calendar) - 1)))).withColumn(
        "net", F.explode(F.sequence(F.lit(0), F.lit(len(nets) - 1))))
    good = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    rows = grid.join(guessed, ["net", "k", "symbol"], "left").select(
        "net", "k", "symbol", F.when(good, F.col("value")).otherwise(0.0).alias("expected_return"), F.when(good, "ok").otherwise("degraded").alias("status"))
    return rows, fitted.select("net", "k", F.posexplode("losses").alias("epoch", "loss"))
