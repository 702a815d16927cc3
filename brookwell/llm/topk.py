"""Exact top-k by inner product: blocks of rows, a pivot table in each, candidates in the order of their bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, runs

#: Rows of a candidate block, pivots of a block, of these the nearest ones that bound a query's scores, candidates that
#: are evaluated first, queries of one product.
BLOCK, PIVOTS, NEAREST, FIRST, BATCH = 8192, 256, 16, 128, 256
#: What a task searches at most: so many queries (all held at once) over so many rows (block by block).
QUERIES, PART = 32_768, 1 << 20


def dots(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of integers held as doubles, exactly; int64, or Python integers where 64 bits could run over."""
    most = float(np.abs(rows).max(initial=0.0)) * float(np.abs(q).max(initial=0.0)) * rows.shape[-1]
    if most < 2.0 ** (24 if rows.dtype == np.float32 else 53):
        return (rows @ q.astype(rows.dtype)).astype(np.int64)
    rows = rows.astype(np.float64)
    if most < 2.0**53:
        return (rows @ q).astype(np.int64)
    if most < 2.0**63:
        return rows.astype(np.int64) @ q.astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in rows], object)


class PivotBlock:
    """Candidates of a block with the distances of their directions to pivots.

    On the unit sphere |q - x|^2 = 2 - 2 cos(q, x). The triangle inequality over the pivots bounds that distance from
    below, and so the cosine, and with the norms the score, from above. Of many pivots the few nearest to a query bound
    it: they tell its own neighbourhood from the rest, and far ones tell next to nothing among many dimensions.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, pivots: int = PIVOTS) -> None:
        by = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[by], rows[by]
        self.most = float(np.abs(rows).max(initial=0.0))
        if self.most**2 * rows.shape[-1] < 2.0**24:
            self.rows = self.rows.astype(np.float32)  # small integers: single precision holds their products
        self.norms = np.sqrt((self.rows.astype(np.float64) ** 2).sum(1))
        unit = self.rows / np.maximum(self.norms, 1e-300)[:, None]
        # pivots far from each other: each next one has the greatest distance to those before
        chosen, far = [0], np.full(len(rows), np.inf)
        table = []
        for _ in range(min(pivots, len(rows))):
            d = np.sqrt(np.maximum(2 - 2 * (unit @ unit[chosen[-1]]), 0))
            table.append(d)
            far = np.minimum(far, d)
            chosen.append(int(far.argmax()))
        self.pivots, self.table = unit[chosen[:-1]], np.array(table, np.float32)
        #: Candidates looked at in the order of their bounds, and by a product over the block.
        self.in_order, self.in_products = 0, 0

    def bounds(self, queries: np.ndarray) -> Iterator[np.ndarray]:
        """Upper bounds of the scores, query by query. Distances are single precision; the slack is ten times its error."""
        own = np.sqrt((queries**2).sum(1))
        d = np.sqrt(np.maximum(2 - 2 * ((queries / np.maximum(own, 1e-300)[:, None]) @ self.pivots.T), 0)).astype(np.float32)
        near = np.argpartition(d, NEAREST, 1)[:, :NEAREST] if d.shape[1] > NEAREST else np.broadcast_to(np.arange(d.shape[1]), d.shape)
        for norm, far, by in zip(own, d, near, strict=True):
            low = np.abs(self.table[by] - far[by, None]).max(0)
            low *= low
            yield norm * self.norms * (1 + 1e-5 - low / 2) + 1e-6

    def _better(self, found: tuple[np.ndarray, np.ndarray], by: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        ids, scores = np.r_[found[0], self.ids[by]], np.concatenate((found[1], scores))
        top = np.lexsort((ids, -scores))[:k]
        return ids[top], scores[top]

    def _products(self, queries: np.ndarray) -> Iterator[np.ndarray]:
        """All scores of each query, exactly."""
        most = self.most * float(np.abs(queries).max(initial=0.0)) * self.rows.shape[-1]
        if most >= 2.0**53:
            yield from (dots(self.rows, q) for q in queries)
        else:
            kind = self.rows.dtype if most < 2.0**24 else np.float64
            yield from (queries.astype(kind) @ self.rows.astype(kind, copy=False).T).astype(np.int64)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Puts the block's rows among the (ids, scores) that each query has found so far, the k best, ties to the smaller
        id, not its own id.

        A query that has no k yet takes the candidates of highest bounds. Those whose bounds reach its k-th score follow
        in the order of their bounds until the next bound is below the k-th score. Where the bounds rule out less than
        half of the block (vectors without any nearness), the rest is a product over the block: the order would spare nothing.
        """
        late: list[tuple[int, np.ndarray]] = []

        def finish() -> None:
            for (i, rest), scores in zip(late, self._products(queries[[i for i, _ in late]]), strict=True):
                best = found[i][1]
                by = np.flatnonzero(rest & (scores >= best[-1]) if len(best) == k else rest)
                found[i] = self._better(found[i], by, scores[by], k)
            late.clear()

        for i, (qid, q, bound) in enumerate(zip(query_ids.tolist(), queries, self.bounds(queries), strict=True)):
            at = np.searchsorted(self.ids, qid)
            if at < len(self.ids) and self.ids[at] == qid:
                bound[at] = -np.inf
            if len(found[i][1]) < k:
                by = np.argpartition(-bound, FIRST)[:FIRST] if len(bound) > FIRST else np.arange(len(bound))
                by = by[np.isfinite(bound[by])]
                found[i] = self._better(found[i], by, dots(self.rows[by], q), k)
                bound[by] = -np.inf
                self.in_order += len(by)
            best = found[i][1]
            rest = bound >= best[-1] if len(best) == k else np.isfinite(bound)
            n = int(np.count_nonzero(rest))
            if 2 * n > len(bound):
                self.in_products += n
                late.append((i, rest))
                if len(late) == BATCH:
                    finish()
            elif n:
                by = np.flatnonzero(rest)
                by = by[np.argsort(-bound[by], kind="stable")]
                step = FIRST
                while len(by) and (len(found[i][1]) < k or bound[by[0]] >= found[i][1][-1]):
                    found[i] = self._better(found[i], by[:step], dots(self.rows[by[:step]], q), k)
                    self.in_order += len(by[:step])
                    by, step = by[step:], 2 * step
        finish()


def quantised(column: pa.Array, factor: float, dim: int) -> np.ndarray:
    return np.floor(factor * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(column), dim)


def compact(rows: np.ndarray) -> tuple[str, np.ndarray]:
    """Whole numbers in the smallest type that holds them all, and its name."""
    most = float(np.abs(rows).max(initial=0.0))
    kind = next((k for k, top in (("i1", 2**7), ("<i2", 2**15), ("<i4", 2**31)) if most < top), "<f8")
    return kind, rows.astype(kind)


def top_k(table: DataFrame, k: int, is_query: Column, factor: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row its k best other rows by the integer inner product
    of floor(factor * x), ties to the smaller id; fewer where there are fewer.

    Rows with a null id, a null vector, or null or non-finite components take no part; of several rows with one id the
    one with the least vector does (a query if any of them is one). Vectors are compared with those of their own
    length. Other columns are ignored; an empty table gives an empty result.

    Rows are made whole numbers of the smallest type and packed before they travel: a copy of a row for each QUERIES
    queries, a copy of a query for each PART rows (or as many as make the tasks of a shuffle). A task holds its
    queries with what they have found and takes its blocks in turn, so that the k-th score of the blocks before spares
    work in the next. A block's pivot table is made by the task that searches it: it takes PIVOTS products of the
    block, and bringing it would take as many numbers a row.
    """
    spark = table.sparkSession
    d = table.select(table[f"`{id_col}`"].cast("long").alias("id"), table[f"`{vector_col}`"].cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    d = d.where("id is not null and v is not null").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    n, n_queries = d.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    if not d.groupBy("id").count().where("count > 1").isEmpty():
        d = d.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, math.ceil(n / BLOCK), min(tasks, math.ceil(n / (BLOCK / 4))))
    parts, groups = max(math.ceil(n / PART), min(tasks, blocks)), max(1, math.ceil(n_queries / QUERIES))
    d = d.select("id", "v", "q", F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(groups)).alias("grp"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Rows of one length and block, and queries of one length and group, as packed arrays."""
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("dim", "query", "at", "code", "ids", "data")}
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                ids, rows = own.column("id").to_numpy(), quantised(own.column("v"), factor, dim)
                asked = own.column("q").to_numpy(zero_copy_only=False).astype(bool)
                for query, at in ((False, own.column("block").to_numpy()), (True, np.where(asked, own.column("grp").to_numpy(), -1))):
                    for a in np.unique(at[at >= 0]).tolist():
                        code, data = compact(rows[at == a])
                        for c, x in zip(out, (dim, query, a, code, ids[at == a].astype("<i8").tobytes(), data.tobytes()), strict=True):
                            out[c].append(x)
            yield out

    packed = map_arrow(d, pack, "dim int, query boolean, at long, code string, ids binary, data binary")
    # a group of queries meets each part of the blocks: task = group * parts + part
    to = F.when(F.col("query"), F.sequence(F.col("at") * parts, F.col("at") * parts + parts - 1)).otherwise(F.sequence(F.col("at") % parts, F.col("at") % parts + (groups - 1) * parts, F.lit(parts)))
    dealt = packed.withColumn("task", F.explode(to)).withColumn("block", F.when(~F.col("query"), F.col("at")).otherwise(-1)).drop("at", "query")

    def unpack(batch: pa.RecordBatch, s: int, e: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
        code, ids, data = (batch.column(c).slice(s, e - s).to_pylist() for c in ("code", "ids", "data"))
        rows = [np.frombuffer(x, c).reshape(len(i) // 8, dim).astype(np.float64) for c, i, x in zip(code, ids, data, strict=True)]
        return np.frombuffer(b"".join(ids), "<i8").astype(np.int64), np.concatenate(rows)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, query_ids, queries, found = None, np.empty(0, np.int64), np.empty((0, 0)), []

        def results() -> dict:
            size = [len(i) for i, _ in found]
            ids, scores = (np.concatenate([f[c] for f in found]) if found else np.empty(0, np.int64) for c in (0, 1))
            return {"query_id": np.repeat(query_ids, size), "vec_id": ids, "score": scores}

        for batch, cut in runs(batches, "task", "dim", "block"):
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                task, dim, block = (batch.column(c)[s].as_py() for c in ("task", "dim", "block"))
                if (task, dim) != held:
                    yield results()
                    held, query_ids, queries, found = (task, dim), np.empty(0, np.int64), np.empty((0, dim)), []
                if block < 0:
                    query_ids, queries = unpack(batch, s, e, dim)
                    found = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(query_ids)
                elif len(query_ids):
                    PivotBlock(*unpack(batch, s, e, dim)).search(query_ids, queries, k, found)
        yield results()

    n_tasks = min(groups * parts, 100_000)
    ordered = dealt.repartitionById(n_tasks, (F.col("task") % n_tasks).cast("int")).sortWithinPartitions("task", "dim", "block")
    near = map_arrow(ordered, search, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
