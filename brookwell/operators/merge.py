"""Upsert, update and delete as rewrites of a table's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_of_each(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """Of rows with one key the last; rows with a null key all stay."""
    w = Window.partitionBy(key).orderBy(order.desc())
    d = rows.withColumn("_last", F.row_number().over(w))
    return d.where((F.col("_last") == 1) | F.col(f"`{key}`").isNull()).drop("_last")


def upserted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table's rows whose key isn't among those of rows, and rows."""
    keys = rows.select(F.col(f"`{key}`").alias("_key"))
    return table.join(keys, F.col(f"`{key}`") == F.col("_key"), "left_anti").unionByName(rows)


def updated(table: DataFrame, changes: dict[str, Column], where: Column | None) -> DataFrame:
    """Columns set where the filter is true; one pass, no shuffle."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return table.select(*[F.when(hit, changes[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in changes else F.col(f"`{c}`") for c in table.columns])


def deleted(table: DataFrame, where: Column | None) -> DataFrame:
    """The rows for which the filter isn't true."""
    return table.limit(0) if where is None else table.where(~F.coalesce(where, F.lit(False)))
