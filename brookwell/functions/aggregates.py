"""The aggregates that a query may name, in any case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError

AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def aggregate(name: str, column: Column | None, kind: T.DataType | None) -> Column:
    """name over a column, or over rows for COUNT(*) (column None). Sums and means of text take its numbers."""
    function = AGGREGATES.get(name.lower())
    if function is None:
        raise EngineError(f"unknown function {name}")
    if column is None:
        if name.lower() != "count":
            raise EngineError(f"{name}(*) has no meaning")
        return F.count(F.lit(1))
    if name.lower() in ("sum", "avg") and isinstance(kind, T.StringType):
        column = column.try_cast("double")
    return function(column)
