"""Exact deduplication with a split for heavy hitters.

1. Each text becomes its SHA-256, one narrow row per document, written once.
2. Every task runs a Misra-Gries summary of ``counters`` digests over its rows. A summary
   misses less than rows / (counters + 1) occurrences of a digest, so after adding the
   summaries up, every digest with more than 2 / (counters + 1) of all rows still holds
   more than 1 / (counters + 1) of them; at most ``counters`` digests can.
3. These candidates are counted exactly (map-side sums), which gives each verified winner:
   the largest id, the size of the group, and how many rows carry that id. The winners'
   table has at most ``counters`` rows, so broadcasting it is bounded.
4. Rows of a heavy digest are settled against the broadcast table, in the scan. All other
   digests hold at most 2 / (counters + 1) of the rows each and meet in an ordinary shuffle.

Defined results: a null text is an empty one; of equal texts the row with the largest id
stays, a null id being the smallest; of rows equal in id and text exactly one stays (for
``keep_rows`` the one whose other columns sort first as text); an empty table gives an
empty table; other columns pass through ``keep_rows`` untouched, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialise

COUNTERS = 2048


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return documents(docs, id_col, text_col).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))


def _shrink(counts: Counter, counters: int) -> Counter:
    """Back to at most ``counters`` entries by lowering all by the first one that must go."""
    if len(counts) <= counters:
        return counts
    values = np.fromiter(counts.values(), np.int64, len(counts))
    floor = int(np.partition(values, len(values) - counters - 1)[len(values) - counters - 1])
    return Counter({k: v - floor for k, v in counts.items() if v > floor})


def frequent(slim: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Candidates for the most frequent digests, at most ``counters`` rows (digest)."""

    def summarise(batches):
        counts: Counter = Counter()
        for batch in batches:
            counts.update(batch.column("digest").to_pylist())
            counts = _shrink(counts, counters)
        yield pa.RecordBatch.from_pydict({"digest": list(counts), "n": list(counts.values())},
                                         schema=pa.schema([("digest", pa.binary()), ("n", pa.int64())]))

    summary = slim.select("digest").mapInArrow(summarise, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    return summary.filter(F.col("n") * (counters + 1) > slim.count()).select("digest")


def winners(slim: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Verified: (digest, keep_id, group_size, n_top) of each frequent digest, exactly counted."""
    candidates = F.broadcast(frequent(slim, counters))  # at most `counters` rows
    per_id = F.struct(F.col("doc_id").alias("keep_id"), F.col("n").alias("n_top"))
    return (slim.join(candidates, "digest").groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
            .groupBy("digest").agg(F.max(per_id).alias("top"), F.sum("n").alias("group_size"))
            .select("digest", "top.keep_id", "group_size", "top.n_top"))


def mark_copies(docs: DataFrame, counters: int = COUNTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    slim = materialise(digests(docs, id_col, text_col), "digests")
    heavy = materialise(winners(slim, counters).withColumnRenamed("keep_id", "heavy_id").withColumnRenamed("group_size", "heavy_size"),
                        "winners")
    known = slim.join(F.broadcast(heavy), "digest", "left")  # at most `counters` rows
    settled = F.col("heavy_size").isNotNull() & ((F.col("n_top") == 1) | ~F.col("doc_id").eqNullSafe(F.col("heavy_id")))
    columns = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")]
    light = Window.partitionBy("digest")
    ordered = light.orderBy(F.col("doc_id").desc_nulls_last())
    rest = (known.filter(~settled)
            .withColumn("group_size", F.coalesce("heavy_size", F.count("*").over(light)))
            .withColumn("keep_id", F.coalesce("heavy_id", F.max("doc_id").over(light)))
            .withColumn("kept", F.row_number().over(ordered) == 1))
    done = (known.filter(settled).withColumn("group_size", F.col("heavy_size")).withColumn("keep_id", F.col("heavy_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("heavy_id"))))
    return done.select(*columns).unionByName(rest.select(*columns))


def keep_rows(docs: DataFrame, counters: int = COUNTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Losing rows of heavy digests leave in the scan; the others are shuffled once, by digest.
    """
    heavy = materialise(winners(materialise(digests(docs, id_col, text_col), "digests"), counters), "winners")
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    key, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    tie = F.to_json(F.struct(*names))
    rows = plain.withColumn("digest", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
    loses = F.col("heavy.group_size").isNotNull() & ~F.col(key).cast("long").eqNullSafe(F.col("heavy.keep_id"))
    left = rows.alias("rows").join(F.broadcast(heavy).alias("heavy"), "digest", "left").filter(~loses)
    order = Window.partitionBy("digest").orderBy(F.col(key).cast("long").desc_nulls_last())
    # ties in the id are looked at only where there are any
    ranked = left.select("digest", *names, F.rank().over(order).alias("r")).filter("r = 1")
    same = ranked.withColumn("r", F.row_number().over(Window.partitionBy("digest").orderBy(tie))).filter("r = 1")
    return same.select(*(F.col(n).alias(f.name) for n, f in zip(names, docs.schema)))
