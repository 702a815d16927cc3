"""Tables, indexes and their metadata: a JSON manifest a table, replaced as a whole with each change.

A manifest names the immutable Parquet folders that make up the table's current version. A change writes new folders
first and publishes them with the manifest, so a failed statement leaves nothing behind but unnamed files.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dialect.nodes import Condition, CreateTable, Literal, Name
from .errors import EngineError, UnknownTable
from .storage import Store

#: Declared types (lower case) and what they are stored as. A timestamp is a count of seconds.
TYPES = {"int": "bigint", "integer": "bigint", "bigint": "bigint", "float": "double", "double": "double", "bool": "boolean", "boolean": "boolean", "string": "string", "text": "string", "varchar": "string", "char": "string", "enum": "string", "timestamp": "bigint", "json": "string"}
NOW = "CURRENT_TIMESTAMP"


@dataclass
class Table:
    name: str
    columns: list[dict]
    primary_key: str | None = None
    auto_increment: bool = False
    next_id: int = 1
    checks: list = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    version: int = 0
    streams: dict[str, int] = field(default_factory=dict)
    #: Another one for a table that is created anew under an old name.
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c["name"], T._parse_datatype_string(c["stored"])) for c in self.columns])

    def column(self, name: str) -> dict | None:
        return next((c for c in self.columns if c["name"] == name), None)

    def conditions(self) -> list[tuple[str, Condition]]:
        def value(c: dict):
            return tuple(map(Literal, c["value"])) if c["op"] == "in" else Literal(c["value"])

        return [(name, Condition(c["column"], c["op"], value(c))) for name, c in self.checks]


def _stored(check: Condition) -> dict:
    value = [v.value for v in check.value] if check.op == "in" else check.value.value
    return {"column": check.column, "op": check.op, "value": value}


def defined(statement: CreateTable, catalog: "Catalog") -> Table:
    """The table that a CREATE TABLE describes."""
    table = Table(statement.table, [])
    for c in statement.columns:
        kind = c.kind.lower()
        if kind not in TYPES:
            raise EngineError(f"unknown type {c.kind}")
        if table.column(c.name):
            raise EngineError(f"column {c.name} is declared twice")
        own: dict = {"name": c.name, "type": kind, "stored": TYPES[kind]}
        if kind in ("varchar", "char") and c.parameters:
            own["length"] = int(c.parameters[0])
        if kind == "enum":
            own["enum"] = [str(p) for p in c.parameters]
        if c.primary_key:
            if table.primary_key:
                raise EngineError("there can be one PRIMARY KEY")
            table.primary_key = c.name
        if c.auto_increment:
            if TYPES[kind] != "bigint":
                raise EngineError("AUTO_INCREMENT is for whole numbers")
            own["auto_increment"] = table.auto_increment = True
        own |= {k: True for k in ("not_null", "unique") if getattr(c, k)}
        if c.default is not None:
            own["default"] = c.default.text if isinstance(c.default, Name) else c.default.value
            if isinstance(c.default, Name) and c.default.text.upper() == NOW:
                own["default"], own["now"] = None, True
        elif kind == "timestamp":
            own["now"] = True
        if c.references:
            parent = catalog.table(c.references.table) if c.references.table != statement.table else None
            columns = parent.columns if parent else [{"name": x.name} for x in statement.columns]
            if not any(x["name"] == c.references.column for x in columns):
                raise EngineError(f"{c.references.table} has no column {c.references.column}")
            own["references"] = asdict(c.references)
        if c.check:
            table.checks.append((c.name, _stored(c.check)))
        table.columns.append(own)
    table.checks += [(name, _stored(c)) for name, c in statement.checks]
    for name, c in table.checks:
        if not table.column(c["column"]):
            raise EngineError(f"check {name}: there is no column {c['column']}")
    return table


class Catalog:
    """Tables kept by the engine, and read-only DataFrames registered under a name.

    A change of several tables is written to a journal first; manifests follow, then the journal goes. One that is found
    when a catalog opens, or after an error, is carried out, so such a change has happened wholly or not at all.
    With cache, tables that are read stay in the executors' memory and on their disks.
    """

    def __init__(self, spark: SparkSession, root: str, cache: bool = False) -> None:
        self.spark, self.store, self.cache = spark, Store(spark, root), cache
        self.tables: dict[str, Table] = {}
        self.views: dict[str, DataFrame] = {}
        self.indexes: dict[str, tuple[str, str]] = {}
        self._cached: dict[str, tuple[tuple[str, int], DataFrame]] = {}
        self._redo()
        for name in self.store.names(self.store.path("tables")):
            if text := self.store.read(self.store.path("tables", name, "manifest.json")):
                known = json.loads(text)
                table = Table(**{k: v for k, v in known.items() if k != "indexes"})
                self.tables[table.name] = table
                self.indexes |= {i: (table.name, c) for i, c in known["indexes"].items()}

    # --- lookups

    def has(self, name: str) -> bool:
        return name in self.tables or name in self.views

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise UnknownTable(f"{name} can't be changed" if name in self.views else f"unknown table {name}")
        return self.tables[name]

    def state(self, name: str) -> tuple[str, int]:
        """What another version of the table, or another table of that name, doesn't have."""
        table = self.tables.get(name)
        return (table.uid, table.version) if table else ("", 0)

    def read(self, name: str) -> DataFrame:
        """A scan of the current version; later versions don't touch its files."""
        if name in self.views:
            return self.views[name]
        table = self.table(name)
        if not self.cache:
            return self.read_parts(table, table.parts)
        known = self._cached.get(name)
        if not known or known[0] != self.state(name):
            self._forget(name)
            known = self._cached[name] = (self.state(name), self.read_parts(table, table.parts).persist())
        return known[1]

    def _forget(self, name: str) -> None:
        if name in self._cached:
            self._cached.pop(name)[1].unpersist()

    def read_parts(self, table: Table, parts: list[str]) -> DataFrame:
        """The rows of some of a table's folders."""
        if not parts:
            return self.spark.createDataFrame([], table.schema)
        return self.spark.read.schema(table.schema).parquet(*(self.store.path("tables", table.name, p) for p in parts))

    def parts_of(self, table: Table, where: Column | None = None, keys: DataFrame | None = None, key: str | None = None) -> dict[str, int]:
        """The folders that hold rows of a filter, or with one of the keys (column _key), and how many of them each."""
        if not table.parts:
            return {}
        df = self.read_parts(table, table.parts).withColumn("_part", F.regexp_extract("_metadata.file_path", r"/(v\d+-[0-9a-f]{32})/", 1))
        df = df if where is None else df.where(where)
        if keys is not None:
            df = df.join(keys, F.col(f"`{key}`") == F.col("_key"), "left_semi")
        return {r["_part"]: r["count"] for r in df.groupBy("_part").count().collect()}

    def indexed(self, table: str) -> list[str]:
        return [c for t, c in self.indexes.values() if t == table]

    # --- changes

    def _manifest(self, name: str) -> str:
        return self.store.path("tables", name, "manifest.json")

    def _redo(self) -> None:
        """Carry out what a journal tells that is still there."""
        at = self.store.path("journal.json")
        if text := self.store.read(at):
            for name, manifest in json.loads(text).items():
                self.store.replace(self._manifest(name), manifest)
            self.store.delete(at)

    def publish(self, *tables: Table) -> None:
        """The next version of tables, all at once; the catalog knows them only when they are there."""
        self._redo()
        new = [replace(t, version=t.version + 1) for t in tables]
        indexes = {t.name: {i: c for i, (n, c) in self.indexes.items() if n == t.name} for t in new}
        texts = {t.name: json.dumps(asdict(t) | {"indexes": indexes[t.name]}) for t in new}
        if len(new) > 1:
            self.store.replace(self.store.path("journal.json"), json.dumps(texts))
            # from here on it has happened, whatever comes between
            self.tables |= {t.name: t for t in new}
            self._redo()
        else:
            for name, text in texts.items():
                self.store.replace(self._manifest(name), text)
        self.tables |= {t.name: t for t in new}

    def write(self, table: Table, rows: DataFrame) -> str:
        """Rows as a new folder of the table, not yet part of it. Indexed columns get Bloom filters and order."""
        part = f"v{table.version + 1}-{uuid.uuid4().hex}"
        out = rows.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in table.schema])
        columns = self.indexed(table.name)
        if columns:
            out = out.sortWithinPartitions(*(F.col(f"`{c}`") for c in columns))
        writer = out.write.option("compression", "zstd")
        for c in columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(self.store.path("tables", table.name, part))
        return part

    def written(self, table: Table, part: str) -> DataFrame:
        return self.read_parts(table, [part])

    def drop_part(self, table: Table, part: str) -> None:
        self.store.delete(self.store.path("tables", table.name, part))

    def create(self, statement: CreateTable) -> Table:
        if self.has(statement.table):
            raise EngineError(f"table {statement.table} exists")
        self.publish(defined(statement, self))
        return self.tables[statement.table]

    def drop(self, name: str) -> None:
        if name in self.views:
            del self.views[name]
            return
        self.table(name)
        if users := sorted({t.name for t in self.tables.values() for c in t.columns if t.name != name and c.get("references", {}).get("table") == name}):
            raise EngineError(f"{name} is referred to by {', '.join(users)}")
        self._redo()
        self.store.delete(self.store.path("tables", name))
        self._forget(name)
        del self.tables[name]
        self.indexes = {i: (t, c) for i, (t, c) in self.indexes.items() if t != name}

    def create_index(self, name: str, table: str, column: str) -> None:
        """Bloom filters and order for a column, in the folders that are there (each is written anew) and those to come."""
        if name in self.indexes:
            raise EngineError(f"index {name} exists")
        own = self.table(table)
        if not own.column(column):
            raise EngineError(f"{table} has no column {column}")
        new = column not in self.indexed(table)
        self.indexes[name] = (table, column)
        made: list[str] = []
        try:
            if new:
                for part in own.parts:
                    made.append(self.write(own, self.read_parts(own, [part])))
            self.publish(replace(own, parts=made) if new else own)
        except BaseException:
            del self.indexes[name]
            for part in made:
                self.drop_part(own, part)
            raise

    def drop_index(self, name: str) -> None:
        if name not in self.indexes:
            raise EngineError(f"unknown index {name}")
        at = self.indexes.pop(name)
        try:
            self.publish(self.table(at[0]))
        except BaseException:
            self.indexes[name] = at
            raise
