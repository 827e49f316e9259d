"""Consecutive numbers for the rows of a table in a given order, without a window over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with a column name: 0, 1, ... in the given order, which must tell all rows apart for a fixed result.

    Rows are dealt to ranges of the order and stored, so that the counts of the ranges and the rows within them agree;
    what goes to one task is the list of ranges (as many rows as shuffle partitions), not the rows."""
    dealt = stored(rows.repartitionByRange(*order).select("*", F.spark_partition_id().alias("_range")))
    ranges = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = ranges.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")
