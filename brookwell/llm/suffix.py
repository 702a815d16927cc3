"""Removal of long repeated byte strings, by anchors, hashed contexts and deep-shallow sorting of the rest.

A string of `length` bytes that stands at two places has, at both, the same leftmost-minimum k-gram (its anchor), so
only places with a repeated anchor can hold one. An anchor's context is all that a window with the anchor in it can
reach. Places whose whole contexts are equal are done with; for the others, the suffixes right of the anchor and the
reversed prefixes left of it are put in order, and common prefix lengths say which windows are repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import clean_rows, map_arrow, materialize, materialize_counted, pieces, runs, spread_join

#: Bytes of text of a bucket (about): what one call holds in memory at once.
BUCKET = 128 << 20
#: Places of one anchor with contexts of their own beyond which their windows are compared by hashes, as a stream.
WIDE = 20_000
_SYMBOLS = np.random.Generator(np.random.PCG64(20240501)).integers(0, 2**64, 256, np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


# --- deep-shallow sorting -------------------------------------------------------------------------------------------


def shallow_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the rows of words (uint64, column 0 first): (order, number of the group of equal rows).

    All segments are split at once: each takes a pivot word, parts into less, equal and greater, and the equal part
    goes on with the next word.
    """
    n, depth = words.shape
    order, seg, at = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    while n:
        new = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        size = np.diff(np.r_[new, n])
        live = np.repeat((size > 1) & (at[new] < depth), size)
        if not live.any():
            break
        own = words[order, np.minimum(at, depth - 1)]
        pivot = np.repeat(own[new + size // 2], size)
        part = np.where(live, (own > pivot).astype(np.int64) + (own >= pivot), 1)
        at = at + (live & (part == 1))
        key = np.repeat(np.arange(len(new)), size) * 3 + part
        by = np.argsort(key, kind="stable")
        order, at, seg = order[by], at[by], key[by]
    return order, np.cumsum(np.r_[True, seg[1:] != seg[:-1]]) - 1 if n else seg


class BlindTrie:
    """A Patricia trie over byte strings: nodes know the depth at which they branch, not the bytes in between."""

    def __init__(self) -> None:
        self.root: list | None = None

    @staticmethod
    def _common(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            return n
        low, high = 0, n
        while high - low > 1:
            mid = (low + high) // 2
            if a[low:mid] == b[low:mid]:
                low = mid
            else:
                high = mid
        return low

    def add(self, s: bytes, value: int) -> None:
        """Blind descent to some leaf, one comparison with its string, then the branch goes where the two part."""
        if self.root is None:
            self.root = [s, [value]]
            return
        node = self.root
        while len(node) == 3:
            depth = node[0]
            branch = s[depth] if depth < len(s) else -1
            node = node[1].get(branch) or node[2]
        other = node[0]
        if other == s:
            node[1].append(value)
            return
        common = self._common(s, other)
        node, up, by = self.root, None, None
        while len(node) == 3 and node[0] < common:
            up, by = node, s[node[0]]
            node = node[1][by]
        own, theirs = s[common] if common < len(s) else -1, other[common] if common < len(other) else -1
        leaf = [s, [value]]
        if len(node) == 3 and node[0] == common:
            node[1][own] = leaf
            return
        made = [common, {own: leaf, theirs: node}, node]
        if up is None:
            self.root = made
        else:
            up[1][by] = made
            if up[2] is node:
                up[2] = made

    def ordered(self) -> list[int]:
        out: list[int] = []
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if len(node) == 2:
                out += node[1]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def deep_shallow_order(heads: np.ndarray, strings: list[bytes], shallow: int = 16) -> np.ndarray:
    """The order of strings within equal heads (uint64); a string comes before its own extensions."""
    padded = np.frombuffer(b"".join(s[:shallow].ljust(shallow, b"\0") for s in strings), ">u8").reshape(len(strings), shallow // 8).astype(np.uint64)
    order, group = shallow_sort(np.column_stack((heads, padded)))
    size = np.bincount(group) if len(group) else group
    start = np.cumsum(size) - size
    for g in np.flatnonzero(size > 1):
        s, e = start[g], start[g] + size[g]
        trie = BlindTrie()
        for i in order[s:e].tolist():
            trie.add(strings[i], i)
        order[s:e] = trie.ordered()
    return order


def common_prefixes(heads: np.ndarray, strings: list[bytes], order: np.ndarray, width: int) -> np.ndarray:
    """Common prefix length of each string with the one before it in order; -1 where the heads differ."""
    n = len(strings)
    if not n:
        return np.empty(0, np.int64)
    length = np.fromiter(map(len, strings), np.int64, n)[order]
    flat = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(n, width)[order]
    other = np.concatenate((flat[1:] != flat[:-1], np.ones((n - 1, 1), bool)), axis=1).argmax(1)
    lcp = np.r_[-1, np.minimum(other, np.minimum(length[1:], length[:-1]))]
    head = heads[order]
    lcp[1:][head[1:] != head[:-1]] = -1
    return lcp


def reach(heads: np.ndarray, left: list[bytes], right: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the largest and smallest offset o for which the window of o bytes left of the anchor and
    span - o right of it occurs at another anchor of the same head; (-1, -1) where none does. left is reversed."""
    n = len(heads)
    far, near = np.full(n, -1), np.full(n, -1)

    def classes(strings: list[bytes]):
        order = deep_shallow_order(heads, strings)
        lcp = common_prefixes(heads, strings, order, max(span, 1))
        length = np.fromiter(map(len, strings), np.int64, n)

        def at(depth: int) -> tuple[np.ndarray, np.ndarray]:
            out = np.empty(n, np.int64)
            out[order] = np.cumsum(lcp < depth)
            return out, length >= depth

        return at

    lefts, rights = classes(left), classes(right)
    for o in range(span + 1):
        (a, a_ok), (b, b_ok) = lefts(o), rights(span - o)
        key = a * (n + 1) + b
        by = np.argsort(key, kind="stable")
        k = key[by]
        same = np.r_[False, k[1:] == k[:-1]]
        hit = np.zeros(n, bool)
        hit[by] = same | np.r_[same[1:], False]
        hit &= a_ok & b_ok
        far[hit] = o
        near[hit & (near < 0)] = o
    return far, near


def anchor_size(length: int) -> int:
    """Bytes of an anchor: the greatest power of two below the length of a repeated string."""
    if length < 2:
        raise ValueError("length must be 2 at least")
    return 1 << ((length - 1).bit_length() - 1)


# --- anchors --------------------------------------------------------------------------------------------------------


def _spread(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each run of width values."""
    out, done = x, 1
    while 2 * done <= width:
        out, done = pick(out[:-done], out[done:]), 2 * done
    return pick(out[: len(x) - width + 1], out[width - done : len(x) - done + 1]) if done < width else out


def anchors(data: bytes, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are a minimum of some window of length bytes."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h, done = _SYMBOLS[np.frombuffer(data, np.uint8)], 1
        while done < k:
            h, done = h[:-done] * _ODD + (h[done:] ^ (h[done:] >> np.uint64(29))), done * 2
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    width = length - k + 1
    least = _spread(h, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(h == _spread(np.concatenate((pad, least, pad)), width, np.maximum))
    return at, h[at]


def context_hashes(data: bytes, at: np.ndarray, span: int, k: int) -> np.ndarray:
    """64-bit hashes of the contexts of the anchors; one cut off by a document's end only equals one cut off alike."""
    n, digest = len(data), xxhash.xxh3_64_intdigest
    view = memoryview(data)
    return np.fromiter((digest(view[max(0, p - span) : p + k + span], min(span, p) * (span + 1) + min(span, n - p - k)) for p in at.tolist()), np.uint64, len(at))


#: What travels in packed arrays: an anchor's place, a place whose whole context is repeated, a request for a context.
PLACE = np.dtype([("head", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("pos", "<u4"), ("many", "u1")])
FULL = np.dtype([("ctx", "<u8"), ("doc", "<i8"), ("pos", "<u4"), ("start", "<u4"), ("end", "<u4")])
ASK = np.dtype([("head", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("pos", "<u4"), ("own", "u1")])


def _equal_neighbours(*columns: np.ndarray) -> np.ndarray:
    out = np.ones(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        out &= c[1:] == c[:-1]
    return out


def _sizes(start: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.r_[start, n])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, keep_bytes: bool = False, partitions: int | None = None) -> DataFrame:
    """Per document: id, n_bytes, spans (maximal removed byte runs, end exclusive), kept_sha256; kept (binary) if asked for.

    A byte goes if a string of length bytes over it also starts anywhere else, be it in the same document.
    A null text counts as empty. Rows with equal texts get equal results, each its own row; ids may be null or repeated.
    Other columns are ignored; an empty table gives an empty result. Texts of any length are taken whole.

    Stages: (1) each task finds its anchors and sends packed arrays of (anchor, context, place) to the anchor's bucket;
    equal contexts within a task send one witness. (2) Buckets tell which contexts are repeated; of anchors with more
    than one context, the places with a context of their own ask for detail. (3) Their texts send these contexts.
    (4) Contexts of an anchor are sorted deep-shallow; what windows are repeated follows; the windows of an anchor with
    more than WIDE contexts are compared by 128-bit hashes instead, as a sorted stream. (5) Texts take the spans in.
    Texts are dealt out once, by a hash of the text, a copy a task at most, and both (3) and (5) read that exchange.
    There are as many buckets of texts and of anchors as their bytes ask for (BUCKET); a task takes its buckets in turn.
    Rows whose text very many have are spread over tasks when they get their spans.
    """
    spark = docs.sparkSession
    anchor = anchor_size(length)
    span = length - anchor
    d = clean_rows(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    d = d.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64("text", F.lit(7)))
    rows = d.select("doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("size"))
    rows, total = materialize_counted(rows.withColumn("row", F.monotonically_increasing_id()), "rows", n=F.count("*"), size=F.sum("size"))
    parts = partitions or max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 16)
    buckets = max(parts, -(-(total["size"] or 0) // BUCKET))

    def bucket_of(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) >> np.uint64(20)).astype(np.int64) % buckets

    def packed(rows: np.ndarray, by: str, sort: int) -> list[tuple[int, int, bytes]]:
        """Rows as blobs, dealt by a column."""
        where = bucket_of(rows[by])
        order = np.argsort(where, kind="stable")
        rows, where = rows[order], where[order]
        start = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(rows) else np.empty(0, np.int64)
        return [(int(where[s]), sort, rows[i : min(i + (1 << 16), s + n)].tobytes()) for s, n in zip(start, _sizes(start, len(rows)), strict=True) for i in range(s, s + n, 1 << 16)]

    def columns(rows: list[tuple[int, int, bytes]]) -> dict:
        return {"bucket": [x[0] for x in rows], "sort": [x[1] for x in rows], "blob": [x[2] for x in rows]}

    def whole(rows: np.ndarray) -> np.ndarray:
        """Places as FULL rows: all of the context goes."""
        out = np.zeros(len(rows), FULL)
        out["ctx"], out["doc"], out["pos"] = rows["ctx"], rows["doc"], rows["pos"]
        out["start"], out["end"] = np.maximum(rows["pos"].astype(np.int64) - span, 0), rows["pos"] + np.uint32(anchor + span)
        return out

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in pieces(batch, "text", 16 << 20):
                made = [np.empty(0, PLACE)]
                for text, key in zip(part.column("text").to_pylist(), part.column("k1").to_pylist(), strict=True):
                    data = text.encode("utf-8", "surrogatepass")
                    at, head = anchors(data, length, anchor)
                    if len(at):
                        own = np.zeros(len(at), PLACE)
                        own["head"], own["pos"], own["ctx"], own["doc"] = head, at, context_hashes(data, at, span, anchor), key
                        made.append(own)
                rows = np.concatenate(made)
                rows = rows[np.lexsort((rows["ctx"], rows["head"]))]
                first = np.flatnonzero(np.r_[True, ~_equal_neighbours(rows["head"], rows["ctx"])]) if len(rows) else np.empty(0, np.int64)
                size = _sizes(first, len(rows))
                full = whole(rows[np.repeat(size > 1, size)])
                rows = rows[first]
                rows["many"] = size > 1
                yield columns([*packed(rows, "head", 0), *packed(full, "doc", 1)])

    blob_kind = "bucket int, sort int, blob binary"
    found = map_arrow(d.select("text", "k1"), find, blob_kind)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, cut in runs(batches, "bucket", "sort"):
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                own = batch.slice(s, e - s)
                if own.column("sort")[0].as_py() == 1:
                    yield {"bucket": own.column("bucket"), "sort": own.column("sort"), "blob": own.column("blob")}
                    continue
                rows = np.frombuffer(b"".join(own.column("blob").to_pylist()), PLACE)
                rows = rows[np.lexsort((rows["ctx"], rows["head"]))]
                new = np.r_[True, ~_equal_neighbours(rows["head"], rows["ctx"])]
                first = np.flatnonzero(new)
                size = _sizes(first, len(rows))
                many = (size > 1) | (np.add.reduceat(rows["many"].astype(np.int64), first) > 0)
                # a witness of its task has had its own verdict there; that it comes again does no harm
                full = whole(rows[np.repeat(many, size)])
                head = np.flatnonzero(np.r_[True, rows["head"][first][1:] != rows["head"][first][:-1]])
                classes = _sizes(head, len(first))
                ask = np.repeat((classes > 1) & (np.add.reduceat((~many).astype(np.int64), head) > 0), classes)
                rest = rows[first[ask]]
                out = np.zeros(len(rest), ASK)
                for c in ("head", "ctx", "doc", "pos"):
                    out[c] = rest[c]
                out["own"] = ~many[ask] + 2 * np.repeat(np.add.reduceat(ask.astype(np.int64), head) > WIDE, classes)[ask]
                yield columns([*packed(full, "doc", 1), *packed(out, "doc", 2)])

    judged = map_arrow(found.repartition(parts, "bucket").sortWithinPartitions("bucket", "sort"), judge, blob_kind)
    # read twice, and its own input is a scan of all texts
    judged = materialize(judged, "places")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys = [*zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True)]
            new = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
            part = batch.take(pa.array(new, pa.int64()))
            yield {"bucket": bucket_of(part.column("k1").to_numpy()), "k1": part.column("k1"), "k2": part.column("k2"), "text": part.column("text")}

    texts = map_arrow(d.select("k1", "k2", "text"), once, T.StructType([T.StructField("bucket", T.LongType()), *(d.schema[c] for c in ("k1", "k2", "text"))])).repartition(parts, "bucket")

    def joined(sort: int, table: DataFrame, fn, schema: str) -> DataFrame:
        """fn over the texts of each bucket and its packed rows, by cogroup."""
        arrow = to_arrow_schema(T._parse_datatype_string(schema))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return pa.Table.from_pydict(fn(left, b"".join(right.column("blob").to_pylist())), arrow)

        rows = table.where(F.col("sort") == sort).select(F.col("bucket").cast("long").alias("bucket"), "blob")
        return texts.groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInArrow(run, schema)

    def each(left: pa.Table, rows: np.ndarray) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
        """Texts with their rows of which the context is as told (64-bit keys of other texts may be equal)."""
        rows = rows[np.lexsort((rows["pos"], rows["doc"]))]
        for k1, k2, text in zip(left.column("k1").to_pylist(), left.column("k2").to_pylist(), left.column("text"), strict=True):
            data = text.as_py().encode("utf-8", "surrogatepass")
            own = rows[np.searchsorted(rows["doc"], k1, "left") : np.searchsorted(rows["doc"], k1, "right")]
            own = own[own["pos"].astype(np.int64) + anchor <= len(data)]
            if len(own):
                at, back = np.unique(own["pos"].astype(np.int64), return_inverse=True)
                own = own[context_hashes(data, at, span, anchor)[back] == own["ctx"]]
            yield k1, k2, data, own

    def ask(left: pa.Table, blob: bytes) -> dict:
        """Contexts, or of places with a very common anchor the hashes of all windows that hold it (window: its offset)."""
        out: dict[str, list] = {c: [] for c in ("window", "head", "ctx", "doc", "pos", "own", "lefts", "rights")}
        done: set[tuple[int, int]] = set()

        def put(*row) -> None:
            for c, v in zip(out, row, strict=True):
                out[c].append(v)

        for k1, k2, data, own in each(left, np.frombuffer(blob, ASK)):
            if (k1, k2) in done:
                continue
            done.add((k1, k2))
            for r in own:
                p, ctx, mine = int(r["pos"]), int(r["ctx"].view(np.int64)), int(r["own"]) & 1
                if r["own"] < 2:
                    put(-1, int(r["head"].view(np.int64)), ctx, k1, p, mine, data[max(0, p - span) : p][::-1], data[p + anchor : p + anchor + span])
                    continue
                for o in range(max(0, p + length - len(data)), min(span, p) + 1):
                    digest = xxhash.xxh3_128_digest(data[p - o : p - o + length], o)  # by offset: else a place meets itself
                    put(o, int.from_bytes(digest[:8], "little", signed=True), ctx, k1, p, mine, digest[8:], b"")
        return out

    contexts = joined(2, judged, ask, "window int, head long, ctx long, doc long, pos long, own int, lefts binary, rights binary")

    def spans_of(batch: pa.RecordBatch, hit: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict:
        out = np.zeros(int(hit.sum()), FULL)
        for c in ("ctx", "doc", "pos"):
            own = batch.column(c).to_numpy()[hit]
            out[c] = own.view(np.uint64) if c == "ctx" else own
        out["start"], out["end"] = start[hit], end[hit]
        return columns(packed(out, "doc", 1))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        batches, wide = iter(batches), []

        def narrow() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                k = int(np.searchsorted(batch.column("window").to_numpy() >= 0, True))
                yield batch.slice(0, k)
                if k < batch.num_rows:
                    wide.append(batch.slice(k))
                    return

        for batch, _ in runs(narrow(), "head"):
            head, pos = batch.column("head").to_numpy(), batch.column("pos").to_numpy()
            far, near = reach(head.view(np.uint64), batch.column("lefts").to_pylist(), batch.column("rights").to_pylist(), span)
            yield spans_of(batch, (batch.column("own").to_numpy() == 1) & (far >= 0), pos - far, pos - near + length)
        # windows come in the order of their hashes: each is held against its neighbours, the last one is carried over
        last, matched = None, False
        for batch in chain(wide, batches):
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            head, rest = batch.column("head").to_numpy(), batch.column("lefts").to_pylist()
            same = (head[1:] == head[:-1]) & np.fromiter((a == b for a, b in zip(rest[1:], rest[:-1], strict=True)), bool, len(head) - 1)
            hit = np.r_[matched, same] | np.r_[same, False]
            last, matched = batch.slice(batch.num_rows - 1), bool(hit[-1])
            start = batch.column("pos").to_numpy() - batch.column("window").to_numpy()
            yield spans_of(batch, hit & (batch.column("own").to_numpy() == 1), start, start + length)

    by = contexts.repartition(parts, "head").sortWithinPartitions(F.col("window") >= 0, "head", "lefts")
    partial = map_arrow(by, order, blob_kind)

    def cut(left: pa.Table, blob: bytes) -> dict:
        out: dict[str, list] = {c: [] for c in ("k1", "k2", "n_bytes", "spans", "kept_sha256", *["kept"] * keep_bytes)}
        done: set[tuple[int, int]] = set()
        for k1, k2, data, own in each(left, np.frombuffer(blob, FULL)):
            if (k1, k2) in done:
                continue
            done.add((k1, k2))
            spans: list[dict] = []
            if len(own):
                by = np.argsort(own["start"], kind="stable")
                start, end = own["start"][by].astype(np.int64), np.maximum.accumulate(np.minimum(own["end"][by].astype(np.int64), len(data)))
                new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
                spans = [{"start": int(s), "end": int(e)} for s, e in zip(start[new], end[np.r_[new[1:], len(end)] - 1], strict=True)]
            edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(data)]
            kept = b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
            for c, v in (("k1", k1), ("k2", k2), ("n_bytes", len(data)), ("spans", spans), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept)):
                if c in out:
                    out[c].append(v)
        return out

    done = joined(1, judged.union(partial), cut, "k1 long, k2 long, n_bytes long, spans array<struct<start: long, end: long>>, kept_sha256 string" + ", kept binary" * keep_bytes)
    names = ["n_bytes", "spans", "kept_sha256"]
    if keep_bytes:  # texts are no values to broadcast
        out = rows.join(done, ["k1", "k2"])
    else:
        of = materialize(done, "cut").join(rows.groupBy("k1", "k2").agg(F.count("*").alias("n")), ["k1", "k2"])
        out = spread_join(rows, of.select("k1", "k2", "n", F.struct(*names).alias("value")), ["k1", "k2"], total["n"], "row")
        out = out.select("doc_id", *(F.col(f"value.{c}").alias(c) for c in names))
    return out.select(F.col("doc_id").alias(id_col), *names, *["kept"] * keep_bytes)
