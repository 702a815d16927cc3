"""Rows from the driver as DataFrames of a table's schema."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _cell(value: Any) -> str | None:
    """A cell as text; its column's type is tried on it later, so that a cell of another type is found and named."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return json.dumps(value) if isinstance(value, (dict, list)) else str(value)


def _in_order(rows: DataFrame) -> DataFrame:
    """One file for rows that came through the driver, so that numbers and last writes go by the order given."""
    return rows.coalesce(1)


def from_mappings(spark: SparkSession, rows: Iterable[Mapping[str, Any]], names: Sequence[str]) -> DataFrame:
    """Text columns of those names; other keys are left out, missing ones are null."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return _in_order(spark.createDataFrame([tuple(_cell(r.get(n)) for n in names) for r in rows], schema))


def from_columns(spark: SparkSession, columns: Mapping[str, Sequence[Any]]) -> DataFrame:
    """Text columns from lists of one length."""
    names = list(columns)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return _in_order(spark.createDataFrame([tuple(map(_cell, r)) for r in zip(*columns.values(), strict=True)], schema))


def fitted(rows: DataFrame, schema: T.StructType) -> tuple[DataFrame, dict]:
    """Rows with the schema's columns, by exact name, and for each column a test that finds cells of another type."""
    out, wrong = [], {}
    for f in schema:
        if f.name not in rows.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c, kind = F.col(f"`{f.name}`"), rows.schema[f.name].dataType
        if kind == f.dataType:
            out.append(c)
            continue
        if isinstance(kind, (T.TimestampType, T.DateType)) and isinstance(f.dataType, T.LongType):
            cast = F.unix_timestamp(c.cast("timestamp"))
        elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) and isinstance(f.dataType, T.StringType):
            cast = F.to_json(c)
        else:
            cast = c.try_cast(f.dataType)
        out.append(cast.alias(f.name))
        wrong[f.name] = (c, cast)
    if not wrong:
        return rows.select(*out), {}
    flags = [F.when(c.isNotNull() & cast.isNull(), True).alias(f"_wrong_{n}") for n, (c, cast) in wrong.items()]
    return rows.select(*out, *flags), {f"type {n}": F.col(f"`_wrong_{n}`") for n in wrong}
