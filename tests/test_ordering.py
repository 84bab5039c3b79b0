"""Places over a whole table against a plain sort, in one part and in many."""

import random

import pytest
from pyspark.sql import functions as F

from pitspark.operators import calendars, ordering


@pytest.fixture(params=[1, 7])
def parts(spark, request):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    for key, value in before.items():
        spark.conf.set(key, value)


def test_places_are_those_of_a_sort(spark, parts):
    draw = random.Random(parts)
    rows = [(f"r{i:03d}", draw.choice([None, 0.5, 0.5, draw.random()]), i) for i in range(300)]
    frame = spark.createDataFrame(rows, "run_id string, sharpe double, order_part int")
    got = ordering.numbered(frame.withColumnRenamed("order_part", "other").repartition(5), F.desc_nulls_last("sharpe"), F.asc("run_id"))
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    assert [r["run_id"] for r in sorted(got.collect(), key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 301))


def test_predecessors_cross_parts(spark, parts):
    dates = spark.range(50).select(F.timestamp_seconds(F.col("id") * 86400).cast("timestamp_ntz").alias("as_of"), F.floor(F.col("id") / 9).cast("string").alias("label"))
    kept = sorted(r["as_of"].toordinal() for r in calendars.on_change_or_due(dates, None).collect())
    assert [d - kept[0] for d in kept] == [0, 9, 18, 27, 36, 45]
    following = {r["as_of"]: r["next_as_of"] for r in calendars.next_dates(dates).collect()}
    order = sorted(following)
    assert [following[d] for d in order] == [*order[1:], None]
    assert calendars.every_nth(dates, "quarterly").count() == 16


def test_empty_table(spark):
    assert ordering.numbered(spark.createDataFrame([], "a int"), F.asc("a")).collect() == []
