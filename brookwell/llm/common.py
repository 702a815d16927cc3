"""What the corpus operators share: the shared folder, tables written there, and file access."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: The word separators of every contract: blank and the ASCII controls 9 to 13 (bytes.split() cuts at just these).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. It is set here only where it is unset and all
    tasks run in this very process (tests); on a cluster a folder of the driver's own machine would be no use."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="brookwell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders made in the innermost scratch() of this thread; None outside of any.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)
#: Folders that hold what applications write, each deleted when its application ends.
_OWNED: set[str] = set()


def _hadoop(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new place in the application's part of the shared folder; nothing else writes there. It goes at the end of the
    scratch() that it is made in, and else with the application."""
    own = f"{shared_dir(spark)}/brookwell-{spark.sparkContext.applicationId}"
    if own not in _OWNED:
        fs, path = _hadoop(spark, own)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _OWNED.add(own)
    out = f"{own}/{label}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(out)
    return out


def delete_dir(spark: SparkSession, uri: str) -> None:
    fs, path = _hadoop(spark, uri)
    fs.delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What operators write inside is deleted at the end: their results must be written elsewhere or used up by then."""
    token = _MADE.set(made := [])
    try:
        yield
    finally:
        _MADE.reset(token)
        for uri in made:
            delete_dir(spark, uri)


def fresh_name(taken: Iterable[str], name: str) -> str:
    """A column name near name that none of those taken is equal to (in any case)."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


#: After so many writes the driver's JVM collects its garbage: only then Spark lets go of the shuffle files, broadcasts and
#: compiled plans of jobs that are done, and an operator of many rounds leaves many behind.
COLLECT = 6
_WRITES = count(1)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again.

    Spark's commit protocol takes one attempt of each task, so a lost executor costs only its own tasks.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    if next(_WRITES) % COLLECT == 0:
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, label: str, **counts: Column) -> tuple[DataFrame, dict]:
    """materialize, and aggregates of the rows that the job which writes them takes along."""
    seen = Observation()
    return materialize(df.observe(seen, *(c.alias(n) for n, c in counts.items())), label), seen.get


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def local_path(uri: str) -> str | None:
    """The plain path of a file: URI (a shared mount); None for object stores and HDFS."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def open_write(uri: str):
    """A binary output stream at uri, parents made."""
    if path := local_path(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    store, path = _filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path)


def open_read(uri: str):
    """A seekable binary input at uri."""
    if path := local_path(uri):
        return open(path, "rb")
    store, path = _filesystem(uri)
    return store.open_input_file(path)


def map_arrow(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str | T.StructType, barrier: bool = False) -> DataFrame:
    """mapInArrow with columns given as a dict of lists or arrays; dict order needn't be the schema's."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in rows(batches):
            yield pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)
        # workers stay for later tasks, and what Arrow's pool keeps would count against the executor all that time
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, kind)


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch cut so that the column's bytes in each piece stay near most (one row may be larger)."""
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def clean_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator reads, by exact name; whatever else the table holds can't clash."""
    return df.select(*[df[f"`{c}`"] for c in columns])


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Whole groups of a stream sorted by keys: a batch and the bounds of its groups (first 0, last num_rows).

    A group is never cut; one that goes over several Arrow batches comes as one batch with that group alone or first.
    """
    held: list[pa.RecordBatch] = []

    def bounds(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(max(batch.num_rows - 1, 0), bool)
        for k in keys:
            c = batch.column(k).to_numpy(zero_copy_only=False)
            new |= c[1:] != c[:-1]
        return np.flatnonzero(new) + 1

    def key(batch: pa.RecordBatch, at: int) -> tuple:
        return tuple(batch.column(k)[at].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        cut = bounds(batch)
        first = int(cut[0]) if len(cut) else batch.num_rows
        if held and key(held[-1], held[-1].num_rows - 1) == key(batch, 0):
            held.append(batch.slice(0, first))
            if first == batch.num_rows:
                continue
            batch, cut = batch.slice(first), cut[1:] - first
        if held:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield whole, [0, whole.num_rows]
            held = []
        last = int(cut[-1]) if len(cut) else 0
        if last:
            yield batch.slice(0, last), [0, *(int(x) for x in cut)]
        held = [batch.slice(last)]
    if held:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield whole, [0, whole.num_rows]


#: Keys that hold more than 1 / HOT of the rows come by broadcast in spread_join; there are fewer than HOT of them.
HOT = 1000
#: Of so few (narrow) rows all may have one key: a task takes them in a moment, and a plain join is a much smaller plan.
PLAIN = 1 << 20


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], total: int, by: str) -> DataFrame:
    """left with the column value (a struct) of right, null where right has no such key; no key's rows in one task.

    right: the keys, n (rows of left with them, or more), value; a row a key. total: rows of left, or more. Fewer than
    HOT keys can have more than total / HOT rows: these come by broadcast. Rows of such a key, or with a null in it, are
    dealt by the column `by` and the others by their keys. `by` must be a value that a repeated task finds again, such as
    a number that was written with the row. Up to PLAIN rows it is a plain join.
    """
    if total <= PLAIN:
        value = right.select(*(F.col(k).alias(f"_key_{k}") for k in keys), "value")
        match = F.lit(True)
        for k in keys:
            match &= F.col(k) == F.col(f"_key_{k}")
        return left.join(value, match, "left").select(*left.columns, "value")
    hot = F.col("n") * HOT > total
    # always 0, but no literal: the optimizer would take that out of the join's keys
    none = F.pmod(F.xxhash64(*keys), F.lit(1).cast("long")).alias("_own")
    often = right.where(hot).select(*(F.col(k).alias(f"_hot_{k}") for k in keys), F.col("value").alias("_hot"))
    rare = right.where(~hot).select(*(F.col(k).alias(f"_rare_{k}") for k in keys), F.col("value").alias("_rare"), none)
    out = left
    for other, prefix in ((F.broadcast(often), "_hot_"), (rare, "_rare_")):
        match = F.lit(True)
        for k in keys:
            match &= F.col(k) == F.col(f"{prefix}{k}")
        if prefix == "_rare_":
            apart = F.col("_hot").isNotNull()
            for k in keys:
                apart |= F.col(k).isNull()
            out = out.withColumn("_salt", F.when(apart, F.xxhash64(by)).otherwise(0))
            match &= F.col("_salt") == F.col("_own")
        out = out.join(other, match, "left")
    return out.select(*left.columns, F.coalesce("_hot", "_rare").alias("value"))


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs of size[i] from start[i] on, in a row."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class RaggedCache:
    """Arrays of ids of items (strings), in flat storage; all are forgotten when there are more than most.

    Items are looked up by 64-bit hashes, but an id is only taken over after the item itself has been compared. Nothing is
    an object of its own: a worker keeps this for all of its tasks.
    """

    def __init__(self, most: int) -> None:
        self.most = most
        self._forget()

    def _forget(self) -> None:
        # hashes in order, with the numbers of their items; by number: an item's symbols, and its ids
        self.keys, self.number = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.begin, self.long, self.symbols = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint8)
        self.at, self.size, self.flat = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint32)

    def _add(self, hashes: np.ndarray, symbols: np.ndarray, start: np.ndarray, long: np.ndarray, parts: list) -> np.ndarray:
        """The numbers of items that are new; hashes are distinct and in order."""
        own = np.arange(len(self.at), len(self.at) + len(hashes), dtype=np.int32)
        to = np.searchsorted(self.keys, hashes)
        self.keys, self.number = np.insert(self.keys, to, hashes), np.insert(self.number, to, own)
        self.begin = np.concatenate((self.begin, len(self.symbols) + np.cumsum(long) - long))
        self.long = np.concatenate((self.long, long.astype(np.int32)))
        self.symbols = np.concatenate((self.symbols, symbols[ragged(start, long)]))
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        self.at = np.concatenate((self.at, len(self.flat) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size.astype(np.int32)))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(parts), np.uint32, int(size.sum()))))
        return own

    def ids(self, hashes: np.ndarray, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, item: Callable[[int], str], learn: Callable[[list[str]], list]):
        """(ids of all items in a row, number of ids of each). The i-th item has that hash, is the run of size[i] symbols
        from start[i] on, and item(i) as a string; what isn't known is asked for at once: learn(list of items)."""
        if len(self.keys) > self.most:
            self._forget()
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        lead = first[back]
        equal = bool((size == size[lead]).all()) and bool((symbols[ragged(start, size)] == symbols[ragged(start[lead], size)]).all())
        at = np.searchsorted(self.keys, distinct)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == distinct[hit]
        number = np.zeros(len(distinct), np.int32)
        number[hit] = known = self.number[at[hit]]
        own, long = first[hit], self.long[known].astype(np.int64)
        equal = equal and bool((size[own] == long).all()) and bool((symbols[ragged(start[own], long)] == self.symbols[ragged(self.begin[known], long)]).all())
        if not equal:
            # two items of one hash: this once all are encoded as they stand
            parts = learn([item(i) for i in range(len(hashes))])
            return np.fromiter(chain.from_iterable(parts), np.uint32), np.fromiter(map(len, parts), np.int64, len(parts))
        if not hit.all():
            new = first[~hit]
            number[~hit] = self._add(distinct[~hit], symbols, start[new], size[new], learn([*map(item, new.tolist())]))
        index = number[back]
        n = self.size[index].astype(np.int64)
        return self.flat[ragged(self.at[index], n)], n
