"""What a statement parses to."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Name:
    """A bare word: a column, a table.column, or, where a value is wanted, a string."""

    text: str


@dataclass(frozen=True)
class Literal:
    """None, bool, int, float, str, or a JSON object or array (dict, list)."""

    value: Any


@dataclass(frozen=True)
class Condition:
    column: str
    op: str  # = != > < >= <= like in
    value: Any  # Literal, or a tuple of Literals for in


#: A filter in disjunctive normal form: any of the tuples, all of its conditions.
Filter = tuple[tuple[Condition, ...], ...]


@dataclass(frozen=True)
class Call:
    function: str
    argument: str  # a column or *


@dataclass(frozen=True)
class Selector:
    """What to put out: "*" (item None), a Name, a Literal or a Call."""

    item: Name | Literal | Call | None
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    kind: str  # inner left right full cross
    table: str
    left: str | None = None
    op: str | None = None
    right: str | None = None
    alias: str | None = None



@dataclass(frozen=True)
class Select:
    selectors: tuple[Selector, ...]
    table: str | None = None
    joins: tuple[Join, ...] = ()
    where: Filter = ()
    group_by: tuple[str, ...] = ()
    order_by: str | None = None
    descending: bool = False
    limit: int | None = None
    offset: int | None = None
    #: `select x ...` and `find x ...`: x is a table if there is one of that name.
    short: bool = False
    alias: str | None = None


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple[Any, ...], ...]


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple[tuple[str, Any], ...]
    where: Filter = ()


@dataclass(frozen=True)
class Delete:
    table: str
    where: Filter = ()


@dataclass(frozen=True)
class Reference:
    table: str
    column: str
    on_delete: str = "no action"
    on_update: str = "no action"


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: str
    parameters: tuple[Any, ...] = ()
    primary_key: bool = False
    auto_increment: bool = False
    not_null: bool = False
    unique: bool = False
    default: Any = None  # Literal or Name
    references: Reference | None = None
    check: Condition | None = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnDef, ...]
    checks: tuple[tuple[str, Condition], ...] = ()


@dataclass(frozen=True)
class DropTable:
    table: str


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str


@dataclass(frozen=True)
class DropIndex:
    name: str


@dataclass(frozen=True)
class ShowTables:
    pass


@dataclass(frozen=True)
class Describe:
    table: str


Statement = Select | Insert | Update | Delete | CreateTable | DropTable | CreateIndex | DropIndex | ShowTables | Describe

__all__ = [n for n in dir() if n[0].isupper() and n not in ("Any",)]
