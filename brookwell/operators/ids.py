"""Consecutive numbers for rows without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, name: str, start: int, where: Column | None = None) -> DataFrame:
    """df with `name` counting up from start over the rows that meet where; null in others.

    df must give the same rows in the same partitions when read twice (a written snapshot does). One count a
    partition, summed up in a small table, gives each partition its first number; within it rows are counted in order.
    """
    chosen = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    d = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_chosen", chosen)
    d = d.withColumn("_part", F.shiftright("_row", 33))
    counts = d.groupBy("_part").agg(F.count(F.when(F.col("_chosen"), 1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_i", F.count(F.when(F.col("_chosen"), 1)).over(within)).join(counts, "_part")
    return d.withColumn(name, F.when(F.col("_chosen"), F.lit(start) + F.col("_before") + F.col("_i") - 1)).drop("_row", "_chosen", "_part", "_i", "_before")
