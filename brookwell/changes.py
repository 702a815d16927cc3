"""INSERT, UPDATE, DELETE and bulk loads: rewrites of snapshots that are checked before they are published."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import Catalog, Table
from .dialect.nodes import Delete, Insert, Update
from .errors import ConstraintError, UnknownColumn
from .operators.constraints import broken, duplicates, orphans, row_checks, taken
from .operators.ids import numbered
from .operators.merge import deleted, last_of_each, updated, upserted
from .operators.predicates import filter_column
from .plans.binder import literal
from .sources.rows import fitted, from_mappings

#: Folders of a table before an insert makes the newer half one: old folders, large by then, are left alone.
MOST_PARTS = 64


def _checked(catalog: Catalog, table: Table, rows: DataFrame, flags: dict[str, Column], against: DataFrame | None, key: str | None) -> None:
    """Raise for what rows break. Row-level constraints take one pass; UNIQUE and REFERENCES a join each.

    against is what the rows come beside (None: nothing); rows of it with a key that rows replace don't count.
    """
    found = broken(rows, flags | row_checks(table.columns, table.schema, table.conditions()))
    for c in table.columns:
        if c.get("unique"):
            n = duplicates(rows, c["name"]).count()
            if against is not None and not n:
                rest = against if key is None else against.join(rows.select(F.col(f"`{key}`").alias("_key")), F.col(f"`{key}`") == F.col("_key"), "left_anti")
                n = taken(rows, rest, c["name"]).count()
            if n:
                found[f"unique {c['name']}"] = n
        if ref := c.get("references"):
            if ref["table"] == table.name:
                parent = rows.select(f"`{ref['column']}`")
                parent = parent if against is None else parent.union(against.select(f"`{ref['column']}`"))
            else:
                parent = catalog.read(ref["table"])
            if n := orphans(rows, c["name"], parent, ref["column"]).count():
                found[f"references {c['name']}"] = n
    if found:
        raise ConstraintError(table.name, found)


def _filled(table: Table, rows: DataFrame, given: list[str], now: int) -> DataFrame:
    """Defaults for columns that weren't given; a given NULL stays NULL."""
    fill = {c["name"]: F.lit(now) if c.get("now") else literal(c["default"]) for c in table.columns if c["name"] not in given and (c.get("now") or c.get("default") is not None)}
    return rows.withColumns({n: v.cast(table.schema[n].dataType) for n, v in fill.items()}) if fill else rows


def load(catalog: Catalog, name: str, rows: DataFrame, validate: bool = True, stream: tuple[str, int] | None = None) -> int:
    """Append rows to a table, or put them in the place of rows with their primary key; how many rows were given.

    Columns go by name: others are left out, missing ones take their default. Rows are written first and checked as
    written, so they are computed once; a key met earlier makes the table be rewritten, else the rows are just added.
    validate=False takes rows as they come: no defaults, constraints or numbers, cells of another type as NULL.
    """
    table = catalog.table(name)
    if stream and table.streams.get(stream[0], -1) >= stream[1]:
        return 0  # a batch that was committed before
    fit, flags = fitted(rows, table.schema)
    if validate:
        if bad := broken(fit, flags) if flags else {}:
            raise ConstraintError(name, bad)
        fit = _filled(table, fit, rows.columns, int(time.time()))
    part = catalog.write(table, fit.select(*[f"`{f.name}`" for f in table.schema]))
    staged = [part]
    try:
        new = catalog.written(table, part)
        n = new.count()
        next_id = table.next_id
        auto = next((c["name"] for c in table.columns if c.get("auto_increment")), None)
        if validate and auto:
            c = F.col(f"`{auto}`")
            missing = new.where(c.isNull() | (c == 0)).count()
            if missing:
                ids = numbered(new, "_id", next_id, c.isNull() | (c == 0))
                part = catalog.write(table, ids.withColumn(auto, F.coalesce("_id", c)))
                staged.append(part)
                new, next_id = catalog.written(table, part), next_id + missing
        key = table.primary_key
        if key:
            again = duplicates(new, key).limit(1).count()
            if again:
                part = catalog.write(table, last_of_each(new.withColumn("_row", F.monotonically_increasing_id()), key, F.col("_row")))
                staged.append(part)
                new = catalog.written(table, part)
        old = catalog.read(name) if table.parts else None
        if validate:
            _checked(catalog, table, new, {}, old, key)
        # only folders that hold a key of the new rows are written again
        keys = new.select(F.col(f"`{key}`").alias("_key")) if key else None
        hit = catalog.parts_of(table, keys=keys, key=key) if key else {}
        parts = [p for p in table.parts if p not in hit]
        if hit:
            part = catalog.write(table, upserted(catalog.read_parts(table, [*hit]), new, key))
            staged.append(part)
        parts.append(part)
        if len(parts) > MOST_PARTS:
            newer = parts[MOST_PARTS // 2 :]
            part = catalog.write(table, catalog.read_parts(table, newer))
            staged.append(part)
            parts = [*parts[: MOST_PARTS // 2], part]
    except BaseException:
        for p in staged:
            catalog.drop_part(table, p)
        raise
    catalog.publish(replace(table, parts=parts, next_id=next_id, streams=table.streams | ({stream[0]: stream[1]} if stream else {})))
    for p in staged:
        if p not in parts:
            catalog.drop_part(table, p)
    return n


def insert(catalog: Catalog, statement: Insert) -> int:
    table = catalog.table(statement.table)
    for c in statement.columns:
        if not table.column(c):
            raise UnknownColumn(f"{table.name} has no column {c}")
    rows = [dict(zip(statement.columns, r, strict=True)) for r in statement.rows]
    return load(catalog, table.name, from_mappings(catalog.spark, rows, statement.columns))


def _resolve(df: DataFrame, table: Table):
    def of(name: str):
        column = name.removeprefix(f"{table.name}.")
        if column not in df.columns:
            raise UnknownColumn(f"{table.name} has no column {name}")
        return F.col(f"`{column}`"), df.schema[column].dataType

    return of


def _children(catalog: Catalog, name: str) -> list[tuple[Table, dict]]:
    return [(t, c) for t in catalog.tables.values() for c in t.columns if c.get("references", {}).get("table") == name]


def _replaced(catalog: Catalog, table: Table, rows: DataFrame) -> None:
    """Publish rows as the whole table. Older folders stay for readers of older versions until vacuum."""
    catalog.publish(replace(table, parts=[catalog.write(table, rows)]))


def update(catalog: Catalog, statement: Update) -> int:
    """Rewrite with new values where the filter is true. Changed rows are checked like inserted ones."""
    table = catalog.table(statement.table)
    df = catalog.read(table.name)
    resolve = _resolve(df, table)
    changes: dict[str, Column] = {}
    for name, value in statement.assignments:
        _, kind = resolve(name)
        value = literal(value)
        changes[name.removeprefix(f"{table.name}.")] = value.try_cast(kind) if value is not None else F.lit(None).cast(kind)
        if _lost(catalog, value, kind):
            raise ConstraintError(table.name, {f"type {name}": 1})
    where = filter_column(statement.where, resolve)
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    touched = catalog.parts_of(table, where)
    n = sum(touched.values())
    if not n:
        return 0
    changed = updated(df.where(hit), changes, None)
    rest = df.where(~hit)
    _checked(catalog, table, changed, {}, rest, None)
    key = table.primary_key
    if key in changes and (duplicates(changed, key).limit(1).count() or taken(changed, rest, key).limit(1).count()):
        raise ConstraintError(table.name, {f"primary key {key}": n})
    whole = table.name in _reached(catalog, table.name)
    with _Followed(catalog) as follow:
        if whole:
            follow.state[table.name] = updated(df, changes, where)
        for column, value in changes.items():
            follow.renamed(table, column, df.where(hit), value)
        own = [] if whole else [*touched]
        _publish(catalog, follow.state, table, own, updated(catalog.read_parts(table, own), changes, where))
    return n


def _lost(catalog: Catalog, value: Column, kind) -> bool:
    before, after = catalog.spark.range(1).select(value.isNotNull(), value.try_cast(kind).isNotNull()).first()
    return before and not after


def delete(catalog: Catalog, statement: Delete) -> int:
    """Rewrite without the rows for which the filter is true; references to them go by their ON DELETE."""
    table = catalog.table(statement.table)
    df = catalog.read(table.name)
    where = filter_column(statement.where, _resolve(df, table))
    gone = df if where is None else df.where(where)
    touched = catalog.parts_of(table, where)
    n = sum(touched.values())
    if not n:
        return 0
    whole = table.name in _reached(catalog, table.name)
    with _Followed(catalog) as follow:
        if whole:
            follow.state[table.name] = deleted(df, where)
        follow.removed(table, gone)
        own = [] if whole else [*touched]
        _publish(catalog, follow.state, table, own, deleted(catalog.read_parts(table, own), where))
    return n


def _publish(catalog: Catalog, state: dict[str, DataFrame], table: Table, touched: list[str], rows: DataFrame) -> None:
    """All that a statement changes, once nothing stands against it, written first and published then: whole tables
    (state), and of the statement's own table rows in the place of the folders touched."""
    parts: dict[str, list[str]] = {}
    try:
        for name, df in state.items():
            parts[name] = [catalog.write(catalog.table(name), df)]
        if touched:
            parts[table.name] = [*(p for p in table.parts if p not in touched), catalog.write(table, rows)]
    except BaseException:
        for name, made in parts.items():
            catalog.drop_part(catalog.table(name), made[-1])
        raise
    catalog.publish(*(replace(catalog.table(name), parts=own) for name, own in parts.items()))


def _reached(catalog: Catalog, name: str) -> set[str]:
    """Tables with references to this one, to these, and so on; itself too where references go in a circle."""
    out, todo = set(), [name]
    while todo:
        for child, _ in _children(catalog, todo.pop()):
            if child.name not in out:
                out.add(child.name)
                todo.append(child.name)
    return out


class _Followed:
    """What references do when the rows that they point at go or get another value: new rows of the tables (state),
    of which nothing is published yet, or an error.

    Each step takes the rows that point at keys of the step before out of their table's state, so a row is taken once,
    and tables that refer to themselves or to each other come to an end. Steps are written to folders that are dropped
    with this object; a state that many steps have changed is written as well, so plans stay short.
    """

    #: Steps on a table's state before it is written.
    STEPS = 6

    def __init__(self, catalog: Catalog) -> None:
        self.catalog, self.state = catalog, {}
        self._made: list[tuple[Table, str]] = []
        self._steps: dict[str, int] = {}

    def __enter__(self) -> _Followed:
        return self

    def __exit__(self, *_: object) -> None:
        for table, part in self._made:
            self.catalog.drop_part(table, part)

    def _written(self, table: Table, rows: DataFrame) -> DataFrame:
        part = self.catalog.write(table, rows)
        self._made.append((table, part))
        return self.catalog.written(table, part)

    def _put(self, table: Table, rows: DataFrame) -> None:
        self._steps[table.name] = self._steps.get(table.name, 0) + 1
        if self._steps[table.name] % self.STEPS == 0:
            rows = self._written(table, rows)
        self.state[table.name] = rows

    def _pointing(self, child: Table, c: dict, keys: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """The child's rows, and those of them that point at the keys (_gone), written, and how many."""
        rows = self.state.get(child.name)
        rows = self.catalog.read(child.name) if rows is None else rows
        hit = self._written(child, rows.join(keys, F.col(f"`{c['name']}`") == F.col("_gone"), "left_semi"))
        return rows, hit, hit.count()

    @staticmethod
    def _keys(rows: DataFrame, column: str) -> DataFrame:
        return rows.select(F.col(f"`{column}`").alias("_gone")).where("_gone is not null").distinct()

    def _set(self, child: Table, c: dict, rows: DataFrame, keys: DataFrame, value: Column) -> None:
        column = F.col(f"`{c['name']}`")
        marked = rows.join(keys, column == F.col("_gone"), "left")
        self._put(child, marked.withColumn(c["name"], F.when(F.col("_gone").isNotNull(), value.cast(child.schema[c["name"]].dataType)).otherwise(column)).drop("_gone"))

    def _refused(self, child: Table, c: dict, action: str, n: int) -> None:
        if action in ("restrict", "no action"):
            raise ConstraintError(child.name, {f"references {c['name']}": n})
        if action == "set null" and c.get("not_null"):
            raise ConstraintError(child.name, {f"not null {c['name']}": n})

    def removed(self, table: Table, gone: DataFrame) -> None:
        """Rows of the table go."""
        todo = [(table, gone)]
        while todo:
            parent, rows = todo.pop(0)
            for child, c in _children(self.catalog, parent.name):
                keys = self._keys(rows, c["references"]["column"])
                left, hit, n = self._pointing(child, c, keys)
                action = c["references"]["on_delete"]
                if not n:
                    continue
                self._refused(child, c, action, n)
                if action == "cascade":
                    self._put(child, left.join(keys, F.col(f"`{c['name']}`") == F.col("_gone"), "left_anti"))
                    todo.append((child, hit))
                else:
                    self._set(child, c, left, keys, F.lit(None))
                    # it may itself be pointed at
                    self.renamed(child, c["name"], hit, F.lit(None))

    def renamed(self, table: Table, column: str, changed: DataFrame, value: Column) -> None:
        """A column of the table's rows gets another value; changed: those rows as they were."""
        todo = [(table, column, changed, value)]
        while todo:
            parent, name, rows, new = todo.pop(0)
            for child, c in _children(self.catalog, parent.name):
                if c["references"]["column"] != name:
                    continue
                keys = self._keys(rows, name).where(~F.col("_gone").eqNullSafe(new))
                left, hit, n = self._pointing(child, c, keys)
                action = c["references"]["on_update"]
                if not n:
                    continue
                self._refused(child, c, action, n)
                own = new if action == "cascade" else F.lit(None)
                self._set(child, c, left, keys, own)
                todo.append((child, c["name"], hit, own))


def compact(catalog: Catalog, name: str, files: int | None = None, sort_by: list[str] | None = None) -> None:
    """The table as one folder, of so many files if told, ranged and sorted by columns if told."""
    table = catalog.table(name)
    df = catalog.read(name)
    if sort_by:
        for c in sort_by:
            if not table.column(c):
                raise UnknownColumn(f"{name} has no column {c}")
        by = [F.col(f"`{c}`") for c in sort_by]
        df = (df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)).sortWithinPartitions(*by)
    elif files:
        df = df.repartition(files)
    _replaced(catalog, table, df)


def vacuum(catalog: Catalog, name: str) -> int:
    """Delete folders that the current version doesn't name; readers of older versions must be done. How many."""
    table = catalog.table(name)
    old = [p for p in catalog.store.names(catalog.store.path("tables", name)) if p.startswith("v") and p not in table.parts]
    for p in old:
        catalog.drop_part(table, p)
    return len(old)

