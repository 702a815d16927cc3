"""A stream's micro-batches into a table, each once, and small writes gathered into larger ones."""

from __future__ import annotations

import threading
from collections.abc import Mapping
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

if TYPE_CHECKING:
    from ..session import Engine


def stream_into(engine: Engine, table: str, stream: DataFrame, checkpoint: str, name: str | None = None, interval: str | None = None, validate: bool = True) -> StreamingQuery:
    """Start a query that loads each micro-batch. The table's manifest keeps the last batch of each stream, so a batch
    that runs again after a failure isn't loaded twice. Without an interval all that is there is taken, then it stops."""
    own = name or f"into_{table}"

    def batch(df: DataFrame, number: int) -> None:
        engine.load(table, df, validate=validate, stream=(own, number))

    writer = stream.writeStream.queryName(own).option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


class BufferedInserter:
    """Rows one by one into a table, written in batches: by number, by age, or when told.

    A batch that breaks a constraint counts as errors and is dropped whole; its message is in `last_error`.
    """

    def __init__(self, engine: Engine, table: str, size: int = 1000, seconds: float | None = None, validate: bool = True) -> None:
        self.engine, self.table, self.size, self.seconds, self.validate = engine, table, size, seconds, validate
        self.rows: list[Mapping[str, Any]] = []
        self.inserted = self.errors = 0
        self.last_error = ""
        self._lock, self._timer = threading.RLock(), None

    def add(self, row: Mapping[str, Any]) -> None:
        with self._lock:
            self.rows.append(row)
            if len(self.rows) >= self.size:
                self.flush()
            elif self.seconds is not None and self._timer is None:
                self._timer = threading.Timer(self.seconds, self.flush)
                self._timer.daemon = True
                self._timer.start()

    def flush(self) -> int:
        """Write what is held; the number of rows written."""
        with self._lock:
            if self._timer:
                self._timer.cancel()
                self._timer = None
            rows, self.rows = self.rows, []
            if not rows:
                return 0
            try:
                n = self.engine.insert_rows(self.table, rows, validate=self.validate)
            except ValueError as e:
                self.errors, self.last_error = self.errors + len(rows), str(e)
                return 0
            self.inserted += n
            return n

    def close(self) -> tuple[int, int]:
        """Flush; rows inserted and rows in error in all."""
        self.flush()
        return self.inserted, self.errors

    def __enter__(self) -> "BufferedInserter":
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
