"""Places in one total order over a whole table, without bringing it into one task.

Rows are range-partitioned by the order, so a part holds a run of it. Each part numbers its own
rows; where a part begins follows from the sizes of the parts before it, one row per part. The
order needs a last key that is unique, both for a definite result and so that no run of
equal rows has to stay in one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def numbered(rows: DataFrame, *order: Column, column: str = "rank") -> DataFrame:
    """``rows`` with their place in ``order``, from 1."""
    kept = materialise(rows.repartitionByRange(*order).withColumn("order_part", F.spark_partition_id()), "ordered")
    sizes = kept.groupBy("order_part").agg(F.count("*").alias("order_size"))
    # one row per part, however many rows the table has
    before = Window.orderBy("order_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("order_part", F.coalesce(F.sum("order_size").over(before), F.lit(0)).alias("order_before"))
    own = F.row_number().over(Window.partitionBy("order_part").orderBy(*order))
    placed = kept.withColumn("order_own", own).join(offsets, "order_part")
    return placed.select(*rows.columns, (F.col("order_before") + F.col("order_own")).cast("int").alias(column))


def neighbours(placed: DataFrame, value: str, step: int, alias: str, column: str = "rank") -> DataFrame:
    """``value`` of the row ``step`` places on (behind, where negative) in a numbered table, null beyond its ends."""
    other = placed.select((F.col(column) - step).cast("int").alias(column), F.col(value).alias(alias))
    return placed.join(other, column, "left")
