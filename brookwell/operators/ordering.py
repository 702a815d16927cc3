"""Sorting with NULL as the greatest value, and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def ordered(column: Column, descending: bool) -> Column:
    return column.desc_nulls_first() if descending else column.asc_nulls_last()


def page(df: DataFrame, limit: int | None, offset: int | None) -> DataFrame:
    """OFFSET, then LIMIT; after a sort both end up in one top-k operator."""
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)
