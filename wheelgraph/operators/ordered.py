"""Numbering and running totals over a whole table without a window of one task.

Rows are dealt by ranges of the order and written with their partition's number, so both passes see the same
parts; one row per part tells where each begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def running(df: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """`df` with the sum of `value` from the first row to this one, by `order`, which must be total for a defined result."""
    dealt = written(df.withColumn("_v", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    sums = dealt.groupBy("_part").agg(F.sum("_v").alias("_s"))
    # as many rows as there are partitions, whatever the table's size
    before = sums.select("_part", (F.sum("_s").over(Window.orderBy("_part")) - F.col("_s")).alias("_before"))
    inside = F.sum("_v").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_in", inside).join(F.broadcast(before), "_part").withColumn(out, F.col("_in") + F.coalesce("_before", F.lit(0))).drop("_v", "_part", "_in", "_before")


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """`df` with its place by `order`, from 1."""
    return running(df, order, F.lit(1).cast("long"), out)
