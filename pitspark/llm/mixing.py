"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Documents of a source queue in a shuffled order (the MD5 of the id) once per allowed
repeat. A queued document finishes, in virtual time, at the source's words so far divided
by the source's weight; the mix is the documents of all queues in order of that time, cut
at the total budget. A source whose queue runs dry leaves its share to the others, so each
ends near the fluid optimum ``target``: min(repeats x size, weight x T), with T chosen so that the
targets add up to the budget.

Running sums never pass through one task: rows are range-partitioned by the order wanted
and written, each part is summed, and a part's rows start at the sum of the parts before it
(:func:`running_sum`). A source that holds a third of all rows is cut into ranges like any
other. Only one row per source and one row per part are ever in one task.

Defined results: a null text has no words; a null source is a source of its own and comes
last; documents without words take part and take nothing; equal rows queue one after the
other; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, materialise

WEIGHTS = (3, 1, 2)
ROWS_EACH = 250_000


def running_sum(df: DataFrame, order: list[Column | str], value: str, rows: int, rows_each: int = ROWS_EACH) -> DataFrame:
    """``df`` with ``until``: the sum of ``value`` over all rows up to and with this one in ``order``."""
    parts = max(8, -(-rows // rows_each))
    ranged = materialise(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("part").agg(F.sum(value).alias("of_part"))
    before = F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part")  # one row per part
    starts = sums.select("part", before.alias("before"))
    within = F.sum(value).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(F.broadcast(starts), "part").withColumn("until", F.col("before") + within).drop("part", "before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """(source, source_size, weight, before, target) of each source; ``before``: words of the sources before it."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    per = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
           .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double"))
           .withColumn("before", F.sum("source_size").over(by_name) - F.col("source_size")))
    # sources that run dry first stand first; behind each of them the others share what is left
    dry = (F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last()
    full = Window.orderBy(*dry)
    everyone = Window.partitionBy()
    level = (F.col("budget") - (F.sum("most").over(full) - F.col("most"))) / (F.sum("weight").over(everyone) - F.sum("weight").over(full) + F.col("weight"))
    first = (per.withColumn("most", (F.col("source_size") * repeats).cast("double"))
             .withColumn("budget", F.sum("source_size").over(everyone) * share)
             .withColumn("level", level).withColumn("level", F.max("level").over(everyone)))  # they rise up to the right one, then fall
    target = F.least("most", F.col("weight") * F.col("level"))
    return first.select("source", "source_size", "weight", "before", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, times, taken."""
    ident = F.col(id_col).cast("long")
    slim = materialise(docs.select(
        ident.alias("doc_id"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col)).alias("size"),
        F.md5(F.concat(F.lit("queue "), F.coalesce(ident.cast("string"), F.lit("")))).alias("turn")), "sizes")
    count = slim.count()
    targets = materialise(source_targets(slim, weights, share, repeats), "targets")  # one row per source
    queue = running_sum(slim, [F.col("source").asc_nulls_last(), "turn", "size"], "size", count)
    queued = materialise(
        queue.alias("q").join(targets.alias("t"), F.col("q.source").eqNullSafe(F.col("t.source")))
        .select("doc_id", "q.source", "size", "source_size", "target", "weight", "turn", (F.col("until") - F.col("before")).alias("words")), "queues")

    def place(again: Column) -> Column:
        """The position of a document's ``again``-th repeat in the mix."""
        finish = (F.col("words") + again * F.col("source_size")) / F.col("weight")
        return F.struct(finish.alias("finish"), F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("source"),
                        again.alias("again"), "turn", "size")

    served = queued.select(F.explode(F.array(*(place(F.lit(i)) for i in range(repeats)))).alias("place"), "size")
    total = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * F.lit(share)).first()[0]
    cut = running_sum(served, ["place"], "size", count * repeats).filter(F.col("until") <= F.lit(total)).agg(F.max("place").alias("last")).first()["last"]
    kinds = ("double", "boolean", "string", "int", "string", "long")
    last = F.struct(*(F.lit(v).cast(kind).alias(n) for (n, v), kind in zip(cut.asDict().items(), kinds))) if cut else None
    times = sum((F.when(place(F.lit(i)) <= last, 1).otherwise(0) for i in range(repeats)) if cut else (), F.lit(0)).cast("long")
    return queued.select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2,
               id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, with all its columns.

    Rows with one id, source and size are numbered on both sides, so repeated rows get the
    decisions of as many queue places, one each.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    ident, text, source = (names[docs.columns.index(c)] for c in (id_col, text_col, source_col))
    taken = mix_sources(docs, weights, share, repeats, id_col, text_col, source_col)

    def numbered(df: DataFrame, *parts: Column) -> DataFrame:
        keyed = df.withColumn("key", F.to_json(F.struct(*parts)))
        return keyed.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("order")))

    rows = numbered(docs.toDF(*names).withColumn("order", F.xxhash64(text)), F.col(ident).cast("long").alias("i"),
                    F.col(source).cast("string").alias("s"), count_words(F.col(text)).alias("w")).alias("rows")
    times = numbered(taken.withColumn("order", -F.col("times")), F.col("doc_id").alias("i"), F.col("source").alias("s"),
                     F.col("size").alias("w")).select("key", "n", "times").alias("times")
    # written as a difference, the numbers stay out of the join's key and the rows are dealt out once
    same = (F.col("rows.key") == F.col("times.key")) & (F.col("rows.n") - F.col("times.n") == 0)
    return (rows.join(times, same).filter("times > 0").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
            .select(*(F.col(n).alias(f.name) for n, f in zip(names, docs.schema))))
