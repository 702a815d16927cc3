"""Declared constraints as DataFrames of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dialect.nodes import Condition
from .predicates import compare


def row_checks(columns: list[dict], schema: T.StructType, checks: list[tuple[str, Condition]]) -> dict[str, Column]:
    """Name of each row-level constraint -> true where a row breaks it. NULL passes all but NOT NULL."""
    out: dict[str, Column] = {}
    for c in columns:
        col, name = F.col(f"`{c['name']}`"), c["name"]
        if c.get("not_null"):
            out[f"not null {name}"] = col.isNull()
        if c.get("enum"):
            out[f"enum {name}"] = ~col.isin(c["enum"])
        if c.get("length") is not None:
            out[f"length {name}"] = F.octet_length(col) > c["length"]
    for name, check in checks:
        kind = schema[check.column].dataType
        value = check.value if check.op == "in" else check.value.value
        # LIKE in a check minds case; a comparison that has no meaning passes
        out[f"check {name}"] = ~F.coalesce(compare(F.col(f"`{check.column}`"), kind, check.op, value, like_case=True), F.lit(True))
    return out


def broken(rows: DataFrame, checks: dict[str, Column]) -> dict[str, int]:
    """Number of rows that break each constraint, in one pass over the rows; only those broken at all."""
    if not checks:
        return {}
    found = rows.agg(*[F.count(F.when(c, 1)).alias(str(i)) for i, c in enumerate(checks.values())]).first()
    return {name: n for name, n in zip(checks, found, strict=True) if n}


def duplicates(rows: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their counts; NULLs are exempt."""
    c = F.col(f"`{column}`")
    return rows.where(c.isNotNull()).groupBy(c.alias(column)).agg(F.count("*").alias("n")).where("n > 1")


def taken(rows: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Rows whose value of a unique column is in the table already."""
    other = table.select(F.col(f"`{column}`").alias("_taken"))
    return rows.join(other, F.col(f"`{column}`") == F.col("_taken"), "left_semi")


def orphans(rows: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose reference isn't NULL and leads nowhere."""
    other = parent.select(F.col(f"`{parent_column}`").alias("_parent"))
    return rows.where(F.col(f"`{column}`").isNotNull()).join(other, F.col(f"`{column}`") == F.col("_parent"), "left_anti")
