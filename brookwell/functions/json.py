"""Values inside JSON text, by path ($.a.b[0]); null where the text is no JSON or the path leads nowhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_value(column: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.try_parse_json(column), path, kind)


def is_json(column: Column) -> Column:
    return F.try_parse_json(column).isNotNull()
