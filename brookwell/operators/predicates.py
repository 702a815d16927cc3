"""Comparisons of a typed column with a literal, and filters in disjunctive normal form."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dialect.nodes import Condition, Filter

_OPS = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}


def unknown() -> Column:
    """Neither true nor false: as a filter it takes no row, as a check it passes."""
    return F.lit(None).cast("boolean")


def _number(text: str) -> float | int | None:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return None


def like_pattern(pattern: str) -> str:
    """Only % and _ are special; a backslash is itself."""
    return pattern.replace("\\", "\\\\")


def compare(column: Column, kind: T.DataType, op: str, value: Any, like_case: bool = False) -> Column:
    """column op value with SQL's third value; = and != NULL mean IS (NOT) NULL.

    Numbers compare as numbers: a number against text takes the text's numeric value, numeric text against a number
    column is that number. What can't be compared (a number with a boolean) is unknown, never an error. LIKE ignores
    case unless like_case. Expressions stay plain column-to-literal where types allow, so that they reach the scan.
    """
    if op == "in":
        found = [compare(column, kind, "=", v.value) for v in value]
        return reduce(operator.or_, found) if found else F.lit(False)
    if value is None:
        return {"=": column.isNull(), "!=": column.isNotNull()}.get(op, unknown())
    if op == "like":
        if not isinstance(kind, T.StringType) or not isinstance(value, str):
            return F.lit(False)
        return (column.like if like_case else column.ilike)(like_pattern(value))
    apply: Callable[[Column, Any], Column] = _OPS[op]
    if isinstance(value, bool):
        return apply(column, F.lit(value)) if isinstance(kind, T.BooleanType) and op in ("=", "!=") else unknown()
    if isinstance(kind, T.NumericType):
        number = _number(value) if isinstance(value, str) else value
        return unknown() if number is None or isinstance(number, (dict, list)) else apply(column, F.lit(number))
    if isinstance(kind, T.StringType):
        if isinstance(value, (int, float)):
            return apply(column.try_cast("double"), F.lit(float(value)))
        return apply(column, F.lit(value)) if isinstance(value, str) else unknown()
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        if isinstance(value, str):
            return apply(column, F.lit(value).try_cast(kind))
        return apply(F.unix_timestamp(column.cast("timestamp")), F.lit(value)) if isinstance(value, (int, float)) else unknown()
    return unknown()


def filter_column(where: Filter, resolve: Callable[[str], tuple[Column, T.DataType]]) -> Column | None:
    """The filter as one column; None where there is none."""

    def one(c: Condition) -> Column:
        column, kind = resolve(c.column)
        return compare(column, kind, c.op, c.value if c.op == "in" else c.value.value)

    return reduce(operator.or_, (reduce(operator.and_, map(one, terms)) for terms in where)) if where else None
