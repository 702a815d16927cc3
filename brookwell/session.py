"""The engine: statements in, DataFrames out."""

from __future__ import annotations

import json
import re
import tempfile
import threading
import uuid
from collections import Counter, OrderedDict
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import changes
from .catalog import Catalog
from .dialect import CreateIndex, CreateTable, Delete, Describe, DropIndex, DropTable, Insert, Select, ShowTables, Update, parse
from .errors import EngineError
from .plans.binder import bind, tables_of
from .sources.csv import read_csv
from .sources.rows import from_columns, from_mappings


class Engine:
    """Tables below a root folder, and a language for them.

    root may be any path that Spark can write. Without one the tables live below spark.checkpoint.dir, or where that is
    unset and all tasks run in this process in a temporary folder, and end with the engine (close()). One engine writes
    a root at a time; any number of readers may. With memory, tables that have been read stay in the executors' memory.
    """

    #: Results that are remembered as JSON, the size of one at most, and rows that are given out as JSON at most.
    RESULTS, RESULT_BYTES, RESULT_ROWS = 5000, 1 << 20, 1_000_000

    def __init__(self, spark: SparkSession, root: str | None = None, memory: bool = False) -> None:
        self.spark = spark
        spark.conf.set("spark.sql.caseSensitive", "true")
        self._own = None
        if root is None:
            shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
            if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise EngineError("a root, or spark.checkpoint.dir, must name a folder that the driver and all executors share")
            root = self._own = f"{shared.rstrip('/')}/engine-{uuid.uuid4().hex}" if shared else "file://" + tempfile.mkdtemp(prefix="brookwell-")
        self.catalog = Catalog(spark, root, memory)
        self._lock = threading.RLock()
        self._results: OrderedDict[tuple, str] = OrderedDict()
        self.counts: Counter[str] = Counter()

    # --- statements

    def execute(self, text: str) -> DataFrame:
        """Run a statement: a query gives its rows, lazily; a change gives one row of what it did."""
        statement = parse(text)
        self.counts["statements"] += 1
        if isinstance(statement, Select):
            return bind(statement, self.catalog)
        if isinstance(statement, ShowTables):
            return self.tables()
        if isinstance(statement, Describe):
            return self.describe(statement.table)
        with self._lock:
            return self._change(statement)

    def _done(self, message: str, rows: int = 0) -> DataFrame:
        return self.spark.createDataFrame([(message, rows)], "message string, rows long")

    def _change(self, s) -> DataFrame:
        if isinstance(s, Insert):
            n = changes.insert(self.catalog, s)
            return self._done(f"Inserted {n}", n)
        if isinstance(s, Update):
            n = changes.update(self.catalog, s)
            return self._done(f"Updated {n}", n)
        if isinstance(s, Delete):
            n = changes.delete(self.catalog, s)
            return self._done(f"Deleted {n}", n)
        if isinstance(s, CreateTable):
            self.catalog.create(s)
            return self._done(f"Created table {s.table}")
        if isinstance(s, DropTable):
            self.catalog.drop(s.table)
            return self._done(f"Dropped table {s.table}")
        if isinstance(s, CreateIndex):
            self.catalog.create_index(s.name, s.table, s.column)
            return self._done(f"Created index {s.name}")
        if isinstance(s, DropIndex):
            self.catalog.drop_index(s.name)
            return self._done(f"Dropped index {s.name}")
        raise TypeError(type(s).__name__)

    def to_json(self, text: str) -> str:
        """A statement's rows as a JSON array. Results of queries over the engine's own tables are remembered by the
        text and the tables' states, so a change makes them new. More than RESULT_ROWS rows are an error: as a DataFrame
        (execute) a result can have any size."""
        statement = parse(text)
        key = None
        if isinstance(statement, Select) and not any(t in self.catalog.views for t in tables_of(statement)):
            key = (text, *((t, *self.catalog.state(t)) for t in tables_of(statement)))
            with self._lock:
                if key in self._results:
                    self._results.move_to_end(key)
                    self.counts["result_hits"] += 1
                    return self._results[key]
        rows = self._rows(self.execute(text))
        out = json.dumps(rows, default=str)
        if key and len(out) <= self.RESULT_BYTES:
            with self._lock:
                self._results[key] = out
                while len(self._results) > self.RESULTS:
                    self._results.popitem(last=False)
        return out

    def _rows(self, df: DataFrame) -> list[dict]:
        rows = df.limit(self.RESULT_ROWS + 1).collect() if df.columns else []
        if len(rows) > self.RESULT_ROWS:
            raise EngineError(f"the result has more than {self.RESULT_ROWS} rows; ask for fewer (limit)")
        return [r.asDict(recursive=True) for r in rows]

    # --- tables

    def register(self, name: str, source: DataFrame | str) -> None:
        """A read-only table: a DataFrame, or a Parquet path."""
        self.catalog.views[name] = self.spark.read.parquet(source) if isinstance(source, str) else source

    def table(self, name: str) -> DataFrame:
        return self.catalog.read(name)

    def lookup(self, name: str, column: str, values: Sequence[Any]) -> DataFrame:
        """Rows by values of a key or indexed column; the condition reaches the files' statistics and Bloom filters."""
        return self.table(name).where(F.col(f"`{column}`").isin(list(values)))

    def tables(self) -> DataFrame:
        known = [(n, len(t.columns)) for n, t in self.catalog.tables.items()] + [(n, len(v.columns)) for n, v in self.catalog.views.items()]
        return self.spark.createDataFrame(sorted(known), "table string, columns int")

    def describe(self, name: str) -> DataFrame:
        """A row a column: type, key, constraints and indexes."""
        kind = "column string, type string, primary_key boolean, constraints string, indexes string"
        if name in self.catalog.views:
            return self.spark.createDataFrame([(f.name, f.dataType.simpleString(), False, "", "") for f in self.catalog.views[name].schema], kind)
        table = self.catalog.table(name)
        rows = []
        for c in table.columns:
            said = [k.replace("_", " ") for k in ("auto_increment", "not_null", "unique") if c.get(k)]
            if "length" in c:
                said.append(f"length <= {c['length']}")
            if "enum" in c:
                said.append(f"in {c['enum']}")
            if c.get("now"):
                said.append("default now")
            elif c.get("default") is not None:
                said.append(f"default {c['default']!r}")
            if ref := c.get("references"):
                said.append(f"references {ref['table']}({ref['column']})")
            said += [f"check {n}: {x['op']} {x['value']!r}" for n, x in table.checks if x["column"] == c["name"]]
            indexes = sorted(i for i, at in self.catalog.indexes.items() if at == (name, c["name"]))
            rows.append((c["name"], c["type"], c["name"] == table.primary_key, "; ".join(said), ", ".join(indexes)))
        return self.spark.createDataFrame(rows, kind)

    # --- bulk

    def load(self, table: str, rows: DataFrame, validate: bool = True, stream: tuple[str, int] | None = None) -> int:
        """Rows of a DataFrame into a table; see changes.load."""
        with self._lock:
            n = changes.load(self.catalog, table, rows, validate, stream)
            self.counts["rows_inserted"] += n
            return n

    def insert_rows(self, table: str, rows: Iterable[Mapping[str, Any]], validate: bool = True) -> int:
        """Rows by column name: unknown names are left out, missing ones take their default."""
        rows = list(rows)
        if not rows:
            return 0
        given = {k for r in rows for k in r}
        names = [c["name"] for c in self.catalog.table(table).columns if c["name"] in given]
        return self.load(table, from_mappings(self.spark, rows, names), validate)

    def insert_values(self, table: str, rows: Iterable[Sequence[Any]], validate: bool = True) -> int:
        """Rows by position."""
        names = [c["name"] for c in self.catalog.table(table).columns]
        return self.insert_rows(table, [dict(zip(names, r, strict=True)) for r in rows], validate)

    def insert_columns(self, table: str, columns: Mapping[str, Sequence[Any]], validate: bool = True) -> int:
        """Columns of one length by name."""
        return self.load(table, from_columns(self.spark, columns), validate)

    def import_csv(self, path: str, table: str = "transactions", delimiter: str = ",", multiline: bool = True) -> int:
        """A CSV file (or folder) into a table of text columns, made if it isn't there; the number of rows. See read_csv."""
        df = read_csv(self.spark, path, delimiter, multiline)
        if not self.catalog.has(table):
            columns = ", ".join(f"{c} string" for c in df.columns)
            self.execute(f"create table {table} ({columns})")
        return self.load(table, df)

    def compact(self, table: str, files: int | None = None, sort_by: list[str] | None = None) -> None:
        with self._lock:
            changes.compact(self.catalog, table, files, sort_by)

    def vacuum(self, table: str) -> int:
        with self._lock:
            return changes.vacuum(self.catalog, table)

    # --- the engine itself

    def stats(self) -> dict[str, int]:
        return {"tables": len(self.catalog.tables), "views": len(self.catalog.views), "indexes": len(self.catalog.indexes), "remembered_results": len(self._results), **self.counts}

    def close(self) -> None:
        if self._own:
            self.catalog.store.delete(self._own)
