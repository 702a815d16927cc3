"""Binds SELECT and FIND to DataFrame operations; optimisation and execution are Catalyst's."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Catalog
from ..dialect.nodes import Call, Join, Name, Select, Selector
from ..errors import EngineError, UnknownColumn, UnknownTable
from ..functions.aggregates import AGGREGATES, aggregate
from ..operators.ordering import ordered, page
from ..operators.predicates import _OPS, filter_column

_JSON = (dict, list)


class Scope:
    """The columns that a query can see: (table, column) in order, each under a unique name in df."""

    def __init__(self, df: DataFrame, columns: list[tuple[str, str, str]]) -> None:
        self.df, self.columns = df, columns
        self.count = Counter(c for _, c, _ in columns)

    @classmethod
    def of(cls, df: DataFrame, table: str, alone: bool) -> "Scope":
        """A single table keeps its names; in a join every column is renamed, so both sides may share any."""
        if alone:
            return cls(df, [(table, c, c) for c in df.columns])
        return cls(df.toDF(*(f"{table}.{c}" for c in df.columns)), [(table, c, f"{table}.{c}") for c in df.columns])

    def find(self, name: str) -> str:
        found = [inner for t, c, inner in self.columns if name == c or name == f"{t}.{c}"]
        if len(found) != 1:
            raise UnknownColumn(f"{'ambiguous' if found else 'unknown'} column {name}")
        return found[0]

    def column(self, name: str) -> tuple[Column, T.DataType]:
        inner = self.find(name)
        return F.col(f"`{inner}`"), self.df.schema[inner].dataType

    def output_name(self, inner: str) -> str:
        """A column's name in the result: its own, with the table's before it if several tables have it."""
        table, column, _ = next(x for x in self.columns if x[2] == inner)
        return column if self.count[column] == 1 else f"{table}_{column}"


def _comparable(a: Column, x: T.DataType, b: Column, y: T.DataType) -> tuple[Column, Column]:
    """Text against a number takes the text's numeric value, null where it has none."""
    if isinstance(x, T.StringType) and isinstance(y, T.NumericType):
        a = a.try_cast("double")
    if isinstance(y, T.StringType) and isinstance(x, T.NumericType):
        b = b.try_cast("double")
    return a, b


def _joined(left: Scope, join: Join, right: Scope) -> Scope:
    both = Scope(left.df, left.columns + right.columns)

    def side(name: str) -> tuple[Column, T.DataType]:
        inner = both.find(name)
        return F.col(f"`{inner}`"), (left.df if inner in left.df.columns else right.df).schema[inner].dataType

    if join.op is None:
        return Scope(left.df.crossJoin(right.df), both.columns)
    (a, x), (b, y) = side(join.left), side(join.right)
    a, b = _comparable(a, x, b, y)
    condition = _OPS[join.op](a, b)
    df = left.df.crossJoin(right.df).where(condition) if join.kind == "cross" else left.df.join(right.df, condition, join.kind)
    return Scope(df, both.columns)


def _constant(catalog: Catalog, selectors: tuple[Selector, ...]) -> DataFrame:
    """SELECT without FROM: one row; no column at all for *."""
    out = []
    for i, s in enumerate(selectors):
        if s.item is None:
            continue
        if isinstance(s.item, Call):
            if s.item.function.lower() not in AGGREGATES:
                raise EngineError(f"unknown function {s.item.function}")
            out.append(F.lit(0).cast("long").alias(s.alias or f"{s.item.function}({s.item.argument})"))
        elif isinstance(s.item, Name):
            out.append(F.lit(s.item.text).alias(s.alias or s.item.text))
        else:
            out.append(literal(s.item.value).alias(s.alias or f"col_{i}"))
    one = catalog.spark.range(1)
    return one.select(*out) if out else one.limit(0).select()


def literal(value) -> Column:
    """A literal as it is stored: JSON as text."""
    import json

    return F.lit(json.dumps(value) if isinstance(value, _JSON) else value)


def bind(select: Select, catalog: Catalog) -> DataFrame:
    """The DataFrame of a query. Raises for unknown tables, columns and functions before anything runs."""
    selectors = select.selectors
    if select.short:
        if catalog.has(select.table):
            selectors = (Selector(None),)
        elif select.order_by is None and select.limit is None and select.offset is None:
            return _constant(catalog, selectors)
    if select.table is None:
        return _constant(catalog, selectors)
    names = [select.alias or select.table, *(j.alias or j.table for j in select.joins)]
    if missing := [n for n in tables_of(select) if not catalog.has(n)]:
        raise UnknownTable(f"unknown table {missing[0]}")
    if len(set(names)) < len(names):
        raise EngineError("two tables of a query have one name; give an alias (as)")
    alone = not select.joins
    scope = Scope.of(catalog.read(select.table), names[0], alone)
    for join, name in zip(select.joins, names[1:], strict=True):
        scope = _joined(scope, join, Scope.of(catalog.read(join.table), name, False))
    where = filter_column(select.where, scope.column)
    df = scope.df if where is None else scope.df.where(where)
    if select.group_by or any(isinstance(s.item, Call) for s in selectors):
        out = _grouped(df, scope, select, selectors)
    else:
        out = _projected(df, scope, select, selectors)
    return page(out, select.limit, select.offset)


def _projected(df: DataFrame, scope: Scope, select: Select, selectors: tuple[Selector, ...]) -> DataFrame:
    out: list[tuple[str, Column]] = []
    for i, s in enumerate(selectors):
        if s.item is None:
            out += [(scope.output_name(inner), F.col(f"`{inner}`")) for _, _, inner in scope.columns]
        elif isinstance(s.item, Name):
            inner = scope.find(s.item.text)
            out.append((s.alias or scope.output_name(inner), F.col(f"`{inner}`")))
        else:
            out.append((s.alias or f"col_{i}", literal(s.item.value)))
    _no_repeats([n for n, _ in out])
    if select.order_by is not None:
        named = dict(out)
        # an alias of this query comes before a column of its tables
        by = named[select.order_by] if any(s.alias == select.order_by for s in selectors) else scope.column(select.order_by)[0]
        df = df.orderBy(ordered(by, select.descending))
    return df.select(*[c.alias(n) for n, c in out])


def _grouped(df: DataFrame, scope: Scope, select: Select, selectors: tuple[Selector, ...]) -> DataFrame:
    keys = [scope.find(n) for n in select.group_by]
    out: list[tuple[str, Column]] = []
    made: list[Column] = []
    for i, s in enumerate(selectors):
        if s.item is None:
            raise EngineError("* can't stand beside GROUP BY or an aggregate")
        if isinstance(s.item, Call):
            c = aggregate(s.item.function, None, None) if s.item.argument == "*" else aggregate(s.item.function, *scope.column(s.item.argument))
            made.append(c.alias(f"_agg{i}"))
            out.append((s.alias or f"{s.item.function}({s.item.argument})", F.col(f"_agg{i}")))
        elif isinstance(s.item, Name):
            inner = scope.find(s.item.text)
            if inner not in keys:
                raise EngineError(f"{s.item.text} must be in GROUP BY")
            out.append((s.alias or scope.output_name(inner), F.col(f"`{inner}`")))
        else:
            out.append((s.alias or f"col_{i}", literal(s.item.value)))
    _no_repeats([n for n, _ in out])
    by = [F.col(f"`{k}`") for k in keys]
    grouped = df.groupBy(*by).agg(*made) if made else df.select(*by).distinct()
    if select.order_by is not None:
        named = dict(out)
        if select.order_by in named:
            column = named[select.order_by]
        elif scope.find(select.order_by) in keys:
            column = F.col(f"`{scope.find(select.order_by)}`")
        else:
            raise EngineError(f"ORDER BY {select.order_by}: not in GROUP BY")
        grouped = grouped.orderBy(ordered(column, select.descending))
    return grouped.select(*[c.alias(n) for n, c in out])


def _no_repeats(names: list[str]) -> None:
    if again := [n for n, k in Counter(names).items() if k > 1]:
        raise EngineError(f"two columns of the result are named {again[0]}; give an alias")


def tables_of(select: Select) -> list[str]:
    return [n for n in (select.table, *(j.table for j in select.joins)) if n]


__all__ = ["bind", "literal", "tables_of"]
