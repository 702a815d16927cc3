"""Near-duplicate groups by Fast Similarity Sketching, banding and verification on the full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clean_rows, map_arrow, materialize, materialize_counted, pieces, runs, spread_join
from .graph import components
from .mixing import row_keys

SHINGLE = 5
#: How likely a pair at the least similarity is to miss all bands at most, to agree in too few coordinates at most, and
#: the coordinates of a sketch at most (where bands of one row need no more).
MISSED, APART, COORDINATES = 1e-10, 1e-9, 170


@lru_cache(maxsize=16)
def sketch_plan(percent: int) -> tuple[int, int, int]:
    """(coordinates, rows of a band, coordinates that must agree before a pair is looked at) for a least similarity.

    Bands have as many rows as the coordinates allow; at 75 that is 43 bands of 3, which a pair at 0.75 all misses with
    0.578 ** 43 = 6e-11. Pairs that agree in fewer coordinates are surely apart (binomial tail), so they are spared.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    p = percent / 100
    for rows in range(8, 0, -1):
        bands = ceil(log(MISSED) / log(1 - p**rows)) if percent < 100 else 1
        if rows * bands <= COORDINATES:
            break
    t, tail, agree = rows * bands, 0.0, 0
    while agree < t and (tail := tail + comb(t, agree) * p**agree * (1 - p) ** (t - agree)) <= APART:
        agree += 1
    return t, rows, agree


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered while there are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def window_hashes(words: list[bytes], hashes: WordHashes, n: int) -> np.ndarray:
    """64-bit hashes of the n-word windows, in order; of the whole sequence where there are fewer words."""
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    with np.errstate(over="ignore"):
        h = np.full(len(words) - size + 1 if words else 0, size, np.uint64)
        for k in range(size):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(words) - size + 1 + k])
    return h


def shingle_set(text: str | None, hashes: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of the text, A-Z in lower case."""
    return np.unique(window_hashes(text.encode("utf-8", "surrogatepass").lower().split() if text else [], hashes, n))


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches of non-empty sets, one row each.

    Round i < t throws each element into one hashed bin with a value above those of earlier rounds; a row whose
    bins are all full is done. Rounds t to 2t - 1 put all elements into bin i - t, so every coordinate fills.
    """
    out = np.full(len(sets) * t, np.iinfo(np.uint64).max, np.uint64)
    empty = np.iinfo(np.uint64).max
    live = np.arange(len(sets))
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            if not len(live):
                break
            own = [sets[d] for d in live]
            at = np.repeat(live, [len(x) for x in own])
            h = _mix(np.concatenate(own) + np.uint64((i + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
            bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
            value = (np.uint64(i) << np.uint64(48)) | (_mix(h) >> np.uint64(16))
            np.minimum.at(out, at * t + bins, value)
            live = live[(out.reshape(-1, t)[live] == empty).any(1)]
    return out.reshape(-1, t)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each sketch; the band's number is part of it."""
    n, t = sketch.shape
    b = t // rows
    h = np.broadcast_to(np.arange(1, b + 1, dtype=np.uint64), (n, b)).copy()
    with np.errstate(over="ignore"):
        for k in range(rows):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + sketch[:, k : b * rows : rows])
    return h


#: Members of a block in a large bucket of sketches, and in a large candidate cluster of full sets.
SKETCH_BLOCK, SET_BLOCK = 4096, 256
#: Members of a large group that meet one copy of a round's hubs, and the hubs of a round (about).
STAR, HUBS = 512, 16


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, exactly; a and b are sorted and distinct."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def forest(ids: np.ndarray, marks: np.ndarray, agree: int, sets: list[np.ndarray] | None = None, percent: int = 75, one: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph in which rows with enough equal marks (and, given sets, a link) are joined.

    Breadth first: a row is only compared with rows that no tree has yet, so a group of like rows takes one pass. Rows
    of `one` are in one tree from the start, by edges from elsewhere.
    """
    out: list[tuple[int, int]] = []
    left = np.arange(len(ids)) if one is None else np.flatnonzero(~one)
    queue = [] if one is None else np.flatnonzero(one).tolist()
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = (marks[left] == marks[x]).sum(1) >= agree
            if sets is not None:
                for i in np.flatnonzero(near):
                    near[i] = ids[left[i]] == ids[x] or linked(sets[x], sets[left[i]], percent)
            if near.any():
                found = left[near]
                queue += found.tolist()
                out += [(int(ids[x]), int(ids[y])) for y in found if ids[x] != ids[y]]
                left = left[~near]
    return out


def _in_blocks(agree: int, percent: int):
    """Edges of a spanning forest in each (g, bi, bj) of a stream sorted by these; with shingles links are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, cut in runs(batches, "g", "bi", "bj"):
            ids = batch.column("vid").to_numpy()
            marks = np.frombuffer(b"".join(batch.column("marks").to_pylist()), np.uint8).reshape(len(ids), -1)
            full = "shingles" in batch.schema.names
            closed = batch.column("closed").to_numpy(zero_copy_only=False)
            edges: list[tuple[int, int]] = []
            cut = np.array(cut)
            if not full:  # groups of two need no search
                twos = cut[:-1][np.diff(cut) == 2]
                twos = twos[(marks[twos] == marks[twos + 1]).sum(1) >= agree]
                edges += zip(ids[twos].tolist(), ids[twos + 1].tolist(), strict=True)
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                own = closed[s:e]
                if e - s > 1 + (not full) and not own.all():
                    sets = [np.frombuffer(x, np.uint64) for x in batch.column("shingles").slice(s, e - s).to_pylist()] if full else None
                    edges += forest(ids[s:e], marks[s:e], agree, sets, percent, own if own.any() else None)
            yield {"a": [x for x, _ in edges], "b": [y for _, y in edges]}

    return run


def _meet(agree: int, percent: int):
    """Rows that are no hub, each with the first hub of its (g, part) that it is linked with, if any; hubs come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, hubs, sketch, sets = None, [], [], []
        for batch in batches:
            full = "shingles" in batch.schema.names
            shingles = batch.column("shingles").to_pylist() if full else [b""] * batch.num_rows
            own, by = [], []
            for i, (g, part, hub, vid, marks, x) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("g", "part", "hub", "vid", "marks")), shingles, strict=True)):
                if (g, part) != at:
                    at, hubs, sketch, sets = (g, part), [], [], []
                mark, mine = np.frombuffer(marks, np.uint8), np.frombuffer(x, np.uint64)
                if hub:
                    hubs.append(vid)
                    sketch.append(mark)
                    sets.append(mine)
                    continue
                near = np.flatnonzero((np.array(sketch) == mark).sum(1) >= agree).tolist() if hubs else []
                own.append(i)
                by.append(next((hubs[k] for k in near if not full or linked(sets[k], mine, percent)), None))
            part = batch.take(pa.array(own, pa.int64()))
            yield {**{c: part.column(c) for c in batch.schema.names if c not in ("part", "hub")}, "by": by}

    return run


def _joined(rows: DataFrame, block: int, agree: int, percent: int, large: bool) -> DataFrame:
    """Edges (a, b) that join what is linked within each group: by full sets where rows have shingles, else by sketch.

    rows: g, first (a member), n (members), vid, marks, and shingles. A group of at most `block` rows is searched as
    one. A larger one grows a tree from its first member: in each round the rows that are still open meet some hubs, at
    first that member, then some that the last round has joined, as long as a round joins a quarter of what was open. A
    round moves only the open rows, so a group of like rows costs a few times its rows. What is open then meets all of
    its group, in pairs of blocks, so no link is lost; rows of the tree needn't meet each other.
    """
    names = rows.columns
    kind = T.StructType([*rows.schema, T.StructField("by", T.LongType())])
    blocks = rows.where(F.col("n") <= block).select(*names, F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.lit(False).alias("closed"))
    edges = []
    if large:
        opened = rows.where(F.col("n") > block)
        hubs = opened.where("vid = first").dropDuplicates(["g"]).withColumn("parts", F.ceil(F.col("n") / F.lit(STAR)).cast("int"))
        opened = opened.withColumn("parts", F.ceil(F.col("n") / F.lit(STAR)).cast("int"))
        before, total, tree = None, 0, []
        while True:
            hubs = hubs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("hub", F.lit(True))
            rays = opened.withColumn("part", F.pmod(F.xxhash64("vid"), "parts").cast("int")).withColumn("hub", F.lit(False))
            both = rays.unionByName(hubs).select(*names, "part", "hub")
            n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            met = map_arrow(both.repartition(n, "g", "part").sortWithinPartitions("g", "part", F.desc("hub")), _meet(agree, percent), kind)
            met, found = materialize_counted(met, "met", new=F.count("by"), all=F.count("*"))
            new, left = found["new"], found["all"] - found["new"]
            total = total or new + left
            tree.append(met.where("by is not null"))
            edges.append(tree[-1].select(F.col("by").alias("a"), F.col("vid").alias("b")))
            still = met.where("by is null").drop("by")
            if not left or not new or before is not None and 4 * new < new + left:
                break
            before = left
            # the next hubs: some of those that this round has joined, in the groups that have open rows
            counts = met.groupBy("g").agg(F.count("*").alias("n"), F.count("by").alias("new")).withColumn("left", F.col("n") - F.col("new"))
            value = counts.select("g", "n", F.struct("new", "left").alias("value"))
            told = spread_join(met, value, ["g"], new + left, "vid").where("value.left > 0 and value.new > 0")
            told = told.withColumn("parts", F.ceil(F.col("value.left") / F.lit(STAR)).cast("int"))
            hubs = told.where("by is not null").where(F.pmod(F.xxhash64("vid", F.lit(len(tree))), "value.new") < HUBS).select(*names, "parts")
            opened = told.where("by is null").select(*names, "parts")
            # groups that this round has brought no further wait for the blocks
            stuck = spread_join(still, value, ["g"], new + left, "vid").where("value.new = 0").select(*names)
            tree.append(stuck.withColumn("by", F.lit(None).cast("long")))
        if left or len(tree) > 1:
            tree.append(still.withColumn("by", F.lit(None).cast("long")))
            every = reduce(DataFrame.unionByName, tree)
            # many groups are done; of the others the open rows go to all pairs of blocks that theirs is in, joined ones only to those with open rows
            value = every.groupBy("g").agg(F.max("n").alias("n"), F.count_distinct(F.when(F.col("by").isNull(), F.col("vid"))).alias("open")).where("open > 0")
            value = value.select("g", "n", F.struct("open").alias("value"))
            rest = spread_join(every.withColumn("closed", F.col("by").isNotNull()), value, ["g"], total, "vid").where("value is not null")
            opens, alls = F.ceil(F.col("value.open") / F.lit(block)).cast("int"), F.ceil(F.col("n") / F.lit(block)).cast("int") + 1
            rest = rest.withColumn("opens", opens).withColumn("alls", F.col("opens") + alls)
            mine = F.when(F.col("closed"), F.col("opens") + F.pmod(F.xxhash64("vid"), F.col("alls") - F.col("opens"))).otherwise(F.pmod(F.xxhash64("vid"), F.col("opens"))).cast("int")
            other = F.when(F.col("closed"), F.sequence(F.lit(0), F.col("opens") - 1)).otherwise(F.sequence(F.lit(0), F.col("alls") - 1))
            rest = rest.withColumn("mine", mine).withColumn("other", F.explode(other))
            blocks = blocks.unionByName(rest.select(*names, F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"), "closed"))
    blocks = blocks.drop("first", "n").repartition("g", "bi", "bj").sortWithinPartitions("g", "bi", "bj", "vid")
    return reduce(DataFrame.unionByName, edges, map_arrow(blocks, _in_blocks(agree, percent), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, shingle: int = SHINGLE, rows: bool = False) -> DataFrame:
    """Per document: id, n_shingles, component_id (smallest id reachable over links), kept (it is that document); with
    rows, also k1, k2 (see mixing.row_keys) and class, a number that only rows of one component share (null for an empty set).

    1. Per text: hashed word shingles, their 128-bit digest, a fast similarity sketch (one byte a coordinate) and its
       band keys. Texts of one digest are one vertex, so copies cost a row, not pairs.
    2. Vertices that share a band key are compared by sketch; what agrees enough forms candidate clusters (components
       over a spanning forest of each bucket).
    3. Links within the clusters are verified on the full sets.
    4. Components of the verified links.

    Sketches and bands follow from percent (see sketch_plan); large buckets and clusters go by hubs, then by blocks (see
    _joined). Null or blank texts have empty sets and are linked with nothing. Rows with equal texts share a component
    whatever their ids; a null id never is a component's id unless all ids of the component are null. Repeated rows
    come back as often as they came in. Other columns are ignored. An empty table gives an empty result. A text is
    taken whole, however long; its set is held by one task.
    """
    t, per_band, agree = sketch_plan(percent)
    kind = docs.schema[id_col].dataType
    d = clean_rows(docs, id_col, text_col).toDF("doc_id", "text")
    d = d.withColumns(dict(zip(("k1", "k2"), row_keys("doc_id", "text"), strict=True)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes = WordHashes()
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = [shingle_set(x, hashes, shingle) for x in part.column("text").to_pylist()]
                some = [i for i, s in enumerate(sets) if len(s)]
                sk = sketches([sets[i] for i in some], t)
                keys, marks = band_keys(sk, per_band).view(np.int64), sk.astype(np.uint8)
                at = {i: k for k, i in enumerate(some)}
                yield {
                    **{c: part.column(c) for c in ("doc_id", "k1", "k2")},
                    "n_shingles": [len(s) for s in sets],
                    "sid": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                    "bands": [keys[at[i]] if i in at else None for i in range(len(sets))],
                    "marks": [marks[at[i]].tobytes() if i in at else None for i in range(len(sets))],
                }

    fields = [("doc_id", kind), ("n_shingles", T.LongType()), ("sid", T.BinaryType()), ("bands", T.ArrayType(T.LongType())), ("marks", T.BinaryType()), ("k1", T.LongType()), ("k2", T.LongType())]
    signed = map_arrow(d, sign, T.StructType([T.StructField(*f) for f in fields]))
    signed, rows_in = materialize_counted(signed.withColumn("row", F.monotonically_increasing_id()), "signed", n=F.count("*"))
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("rep")
    reps = signed.where("sid is not null").groupBy("sid").agg(rep, F.count("*").alias("n_rows"), F.first("bands").alias("bands"), F.first("marks").alias("marks"))
    reps, vertices = materialize_counted(reps.withColumn("vid", F.monotonically_increasing_id()), "vertices", n=F.count("*"))

    bands = reps.select("vid", F.explode("bands").alias("g"))
    often, buckets = materialize_counted(bands.groupBy("g").agg(F.count("*").alias("n"), F.min("vid").alias("first")).where("n > 1"), "often", most=F.max("n"))
    met = bands.join(often, "g").join(reps.select("vid", "marks"), "vid").select("g", "first", "n", "vid", "marks")
    proposed = _joined(met, SKETCH_BLOCK, agree, percent, (buckets["most"] or 0) > SKETCH_BLOCK)
    clusters = materialize(components(proposed), "clusters")

    sizes = clusters.groupBy("root").agg(F.count("*").alias("n"))
    members = clusters.withColumnRenamed("v", "vid").join(sizes, "root").join(reps.select("vid", "rep.k1", "rep.k2"), "vid")
    texts = d.select("k1", "k2", "text").join(members, ["k1", "k2"]).select("root", "n", "vid", "text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes, last = WordHashes(), None
        for batch in batches:
            for part in pieces(batch, "text"):
                ids = part.column("vid").to_pylist()
                new = [i for i, v in enumerate(ids) if v != (ids[i - 1] if i else last)]  # a repeated row's set is made once
                last = ids[-1]
                part = part.take(pa.array(new, pa.int64()))
                sets = [shingle_set(x, hashes, shingle) for x in part.column("text").to_pylist()]
                marks = sketches(sets, t).astype(np.uint8)
                yield {"g": part.column("root"), "first": part.column("root"), "n": part.column("n"), "vid": part.column("vid"), "marks": [m.tobytes() for m in marks], "shingles": [s.tobytes() for s in sets]}

    full, sets = materialize_counted(map_arrow(texts, whole, "g long, first long, n long, vid long, marks binary, shingles binary"), "sets", most=F.max("n"))
    joined = components(_joined(full, SET_BLOCK, agree, percent, (sets["most"] or 0) > SET_BLOCK))

    at = reps.select("vid", "sid", "rep", "n_rows").join(joined.withColumnRenamed("v", "vid"), "vid", "left").withColumn("root", F.coalesce("root", "vid"))
    # a component of many vertices is no hot key here: its rows are one a text, and the least is found by parts first
    least = at.groupBy("root").agg(F.min("rep").alias("least"), F.count("*").alias("n"))
    of = spread_join(at, least.select("root", "n", F.struct("least.doc_id").alias("value")), ["root"], vertices["n"], "vid")
    of = of.select("sid", F.col("n_rows").alias("n"), F.struct(F.col("value.doc_id").alias("component_id"), F.col("root").alias("class")).alias("value"))
    out = spread_join(signed.select("doc_id", "n_shingles", "sid", "k1", "k2", "row"), of, ["sid"], rows_in["n"], "row")
    out = out.withColumn("component_id", F.when(F.col("value").isNotNull(), F.col("value.component_id")).otherwise(F.col("doc_id")))
    more = ["k1", "k2", F.col("value.class").alias("class")] if rows else []
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *more)
