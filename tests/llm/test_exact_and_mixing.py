from collections import Counter

import pytest
from pitspark.llm import exact, mixing
from pyspark.sql import functions as F
from rows import ROWS


@pytest.mark.parametrize("counters", [1, 2, 2048])
def test_one_of_equal_texts_stays(spark, awkward, counters):
    many = awkward.unionByName(awkward.filter("doc_id = 14").withColumn("doc_id", F.explode(F.array(*map(F.lit, range(100, 140))))))
    many = many.unionByName(many.filter("doc_id = 139"))
    marked = exact.mark_copies(many, counters).collect()
    groups: dict = {}
    for row in many.collect():
        groups.setdefault(row.text or "", []).append(row.doc_id)
    sizes = Counter((r.keep_id, r.group_size) for r in marked)
    assert sizes == Counter({(max(ids), len(ids)): len(ids) for ids in groups.values()})
    assert sum(r.kept for r in marked) == len(groups) and all(r.doc_id == r.keep_id for r in marked if r.kept)
    kept = exact.keep_rows(many, counters)
    assert kept.columns == many.columns
    assert sorted((r.text or "", r.doc_id) for r in kept.collect()) == sorted((t, max(ids)) for t, ids in groups.items())


def test_null_ids_are_smallest(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "b"), (None, "b"), (3, "a")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.mark_copies(docs).collect()), key=repr)
    assert got == sorted([(None, 3, 2, False), (3, 3, 2, True), (None, None, 2, True), (None, None, 2, False)], key=repr)


def test_frequent_digests_are_candidates(spark):
    docs = spark.range(0, 1000, numPartitions=5).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    slim = exact.digests(docs)
    found = exact.winners(slim, counters=9).collect()
    assert [(r.keep_id, r.group_size, r.n_top) for r in found if r.group_size > 1] == [(999, 334, 1)]
    assert exact.frequent(slim, counters=9).count() <= 9


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 50)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    budget = 1.5 * 1160
    assert abs(sum(got.values()) - budget) < 1e-6
    assert got["a"] == 200 and got["b"] == 20 and got[None] == 100 and abs(got["c"] - (budget - 320)) < 1e-6


def test_running_sum_over_parts(spark):
    df = spark.range(0, 3000).select(F.col("id"), (F.col("id") % 7).alias("v"))
    got = {r.id: r.until for r in mixing.running_sum(df, ["id"], "v", 3000, rows_each=100).collect()}
    total = 0
    for i in range(3000):
        total += i % 7
        assert got[i] == total


def test_mixed_rows_follow_the_decisions(spark, awkward):
    taken = mixing.mix_sources(awkward).collect()
    want = Counter()
    for r in taken:
        want[r.doc_id] += r.times
    mixed = mixing.mixed_rows(awkward)
    assert mixed.columns == awkward.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +want
    assert sorted(r.taken for r in taken) == sorted(r.taken for r in mixing.mix_sources(awkward).collect())
    assert len(taken) == len(ROWS)


def test_no_rows(spark, nothing):
    assert exact.mark_copies(nothing).count() == 0 and exact.keep_rows(nothing).count() == 0
    assert mixing.mix_sources(nothing).count() == 0 and mixing.mixed_rows(nothing).count() == 0
