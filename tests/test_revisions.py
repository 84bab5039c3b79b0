"""The revision stream over several batches: late revisions, replays, compaction and what is kept."""

import random
from datetime import datetime, timedelta

from pitspark.schemas import PRICES
from pitspark.streaming import ingest

ZERO = datetime(2020, 1, 1)


def _landed(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, PRICES).coalesce(1).write.parquet(f"{folder}/part{i}")
    return spark.readStream.schema(PRICES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))


def _batches(n):
    draw = random.Random(n)
    return [[(draw.choice("ABC"), ZERO + timedelta(days=draw.randrange(20)), ZERO + timedelta(days=draw.randrange(60)), float(draw.randrange(1000)), False) for _ in range(40)]
            for _ in range(n)]


def _newest(batches):
    best = {}
    for row in (r for b in batches for r in b):
        if row[:2] not in best or (row[2], row[3]) > best[row[:2]]:
            best[row[:2]] = (row[2], row[3])
    return {(*k, *v) for k, v in best.items()}


def _read(spark, path):
    rows = [(r["symbol"], r["event_date"], r["available_date"], r["close"]) for r in ingest.read_revisions(spark, path).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_many_batches_with_compaction(spark, tmp_path):
    batches = _batches(7)
    keys = len({r[:2] for b in batches for r in b})
    store, seen = str(tmp_path / "store"), []

    def each(batch, i):
        ingest.merge_revisions(batch, i, store, compact_every=3)
        seen.append((i, ingest.compacted_upto(spark, store), ingest.revision_parts(spark, store).count()))

    ingest.drain(_landed(spark, tmp_path / "in", batches), each, str(tmp_path / "progress"))
    assert _read(spark, store) == _newest(batches)
    assert [i for i, *_ in seen] == list(range(7)) and [upto for _, upto, _ in seen] == [-1, -1, 2, 2, 2, 5, 5]
    # what a reader merges: one row per key, and those of fewer batches than lie between two compactions
    assert all(rows <= keys + 2 * 40 for *_, rows in seen)


def test_the_stream_keeps_no_state(spark, tmp_path):
    stream = _landed(spark, tmp_path / "in", _batches(3))
    query = stream.writeStream.foreachBatch(lambda b, i: ingest.merge_revisions(b, i, str(tmp_path / "store"))).option(
        "checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    assert all(p["stateOperators"] == [] for p in query.recentProgress)


def test_a_late_revision_supersedes_and_an_old_one_does_not(spark, tmp_path):
    store, day = str(tmp_path), ZERO
    for i, (lag, close) in enumerate([(5, 1.0), (3, 2.0), (9, 3.0), (7, 4.0)]):
        ingest.merge_revisions(spark.createDataFrame([("A", day, day + timedelta(days=lag), close, False)], PRICES), i, store, compact_every=2)
    assert _read(spark, store) == {("A", day, day + timedelta(days=9), 3.0)}


def test_replays_and_an_unfinished_compaction(spark, tmp_path):
    batches, store = _batches(4), str(tmp_path)
    for i in (0, 1, 1, 2, 3, 3):
        ingest.merge_revisions(spark.createDataFrame(batches[i], PRICES), i, store, compact_every=2)
    # a base without its mark, as a lost driver would leave it
    spark.createDataFrame(batches[0][:1], PRICES).write.parquet(f"{store}/base/upto=99")
    assert _read(spark, store) == _newest(batches)
