"""Byte-level BPE in padded numpy matrices: distinct pre-tokens, bucketed by length, merge one pair a row and round."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import RaggedCache, clean_rows, map_arrow, pieces

NONE = np.iinfo(np.int32).max
#: Pre-tokens of up to this many bytes go in matrices of their length's bucket; so many pre-tokens are remembered.
SHORT, REMEMBERED = 64, 500_000
#: Bytes of text that are encoded at once; the arrays made on the way take some fifty times that.
PIECE = 1 << 19


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """(left id, right id) -> id of the merged bytes, by open addressing in two flat arrays."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = [(ranks[b[:i]], ranks[b[i:]], r) for b, r in ranks.items() if len(b) > 1 for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks]
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.ids = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        left, right, out = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 3
        key = left << 32 | right
        at, todo = self._slot(key), np.arange(len(key))
        while len(todo):  # all that find their slot free settle at once, one a slot; the rest go on by one
            free = todo[self.keys[at[todo]] == -1]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.ids[at[won]] = key[won], out[won]
            todo = np.setdiff1d(todo, won)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of merged pairs; NONE where a pair has none or either side is padding (-1)."""
        out = np.full(left.shape, NONE, np.int32)
        todo = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        flat = out.ravel()
        key = (left.ravel()[todo].astype(np.int64) << 32) | right.ravel()[todo]
        at = self._slot(key)
        while len(todo):
            got = self.keys[at]
            hit = got == key
            flat[todo[hit]] = self.ids[at[hit]]
            on = ~hit & (got != -1)
            todo, key, at = todo[on], key[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(left.shape)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Splitter:
    """The public pattern's matches as array operations over many texts.

    Runs of letters, numbers, blanks or others are the matches, but for: of blanks before something else the last one
    stands alone, or goes with what follows if it is a space; and an apostrophe that begins a run of others takes one of
    the endings s t re ve m ll d from the letters after it.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self) -> None:
        every = "".join(map(chr, range(0x110000)))
        self.kind = np.full(0x110000, 3, np.uint8)
        for k, p in enumerate((r"\s+", r"\p{L}+", r"\p{N}+")):
            for m in regex.finditer(p, every):
                self.kind[m.start() : m.end()] = k

    def starts(self, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where matches start in the code points of texts that begin at begins."""
        n, kind = len(points), self.kind[points]
        first = np.zeros(n + 4, bool)
        first[begins] = True
        first[n:] = True
        start = first.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        last = np.flatnonzero((kind[:-1] == 0) & (kind[1:] != 0) & ~first[1:n])
        start[last] = True
        start[last[points[last] == 32] + 1] = False
        q = np.flatnonzero((points == 39) & start[:n])
        after = np.r_[points, np.zeros(3, points.dtype)]
        a, b = after[q + 1], after[q + 2]
        here = ~first[q + 1]
        one = q[here & np.isin(a, [ord(c) for c in "stmd"])]
        start[one + 1], start[one + 2] = False, True
        two = here & ~first[q + 2] & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))
        two = q[two]
        start[two + 1], start[two + 2], start[two + 3] = False, False, True
        return np.flatnonzero(start[:n])


class ByteBPE:
    """Encodes and decodes like the ranks' byte-pair encoding; made once a worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b
        self.names = [str(i) for i in range(len(self.bytes_of))]
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.ranks, self.pairs, self.split = ranks, PairTable(ranks), regex.compile(pattern).finditer
        self.splitter = Splitter() if pattern == Splitter.PATTERN else None
        self.cache = RaggedCache(REMEMBERED)

    def _matrix(self, tokens: list[bytes]) -> list[list[int]]:
        """Ids of tokens of like length: in each round every row merges its leftmost pair of least rank."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ids = np.full((len(tokens), int(sizes.max())), -1, np.int32)
        ids[np.arange(ids.shape[1]) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(tokens), np.uint8)]
        out: list[list[int]] = [[]] * len(tokens)
        rows = np.arange(len(tokens))
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while True:
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            least = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE, np.int32)
            done = least == NONE
            for r, own, n in zip(rows[done].tolist(), ids[done].tolist(), (ids[done] >= 0).sum(1).tolist(), strict=True):
                out[r] = own[:n]
            if done.all():
                return out
            rows, ids, ranks, at, least = rows[~done], ids[~done], ranks[~done], at[~done], least[~done]
            n, lane = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
            # compaction: what stands right of the merged pair moves up by one
            ids = np.take_along_axis(ids, lane + (lane > at[:, None]), 1)
            ids[n, at] = least
            lane = lane[:-1]
            ranks = np.take_along_axis(ranks, lane + (lane > at[:, None]), 1) if len(lane) else ranks[:, :0]
            if len(lane):
                before, after = at > 0, at < len(lane)
                ranks[n[before], at[before] - 1] = self.pairs.find(ids[n[before], at[before] - 1], ids[n[before], at[before]])
                ranks[n[after], at[after]] = self.pairs.find(ids[n[after], at[after]], ids[n[after], at[after] + 1])
            used = int((ids >= 0).sum(1).max())
            ids, ranks = ids[:, :used], ranks[:, : max(used - 1, 0)]

    def _long(self, token: bytes) -> list[int]:
        """One long token: a round merges all places of the least pair from left to right. That is what leftmost-first
        does unless a merged place makes a pair of lesser rank with what stands beside it at that time; then only the
        leftmost place is merged."""
        ids = self.byte_ids[np.frombuffer(token, np.uint8)]
        ranks = self.pairs.find(ids[:-1], ids[1:])
        while len(ids) > 1 and (least := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == least)
            # of overlapping places (a run of one symbol) every other one is merged
            run = np.cumsum(np.r_[True, np.diff(at) > 1])
            at = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0]
            merged = np.full(len(at), least, np.int32)
            after = np.r_[ids, np.int32(-1), np.int32(-1)][at + 2]
            before = np.where(np.r_[False, np.diff(at) == 2], least, np.r_[-1, ids][at])
            if min(self.pairs.find(merged, after).min(), self.pairs.find(before, merged).min()) < least:
                at = at[:1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids.copy()
            ids[at] = least
            ids = ids[keep]
            ranks = self.pairs.find(ids[:-1], ids[1:])
        return ids.tolist()

    def encode_tokens(self, tokens: list[bytes]) -> list[list[int]]:
        """Ids of each token; buckets of powers of two keep padding below half."""
        out: list[list[int]] = [[]] * len(tokens)
        buckets: dict[int, list[int]] = {}
        for i, t in enumerate(tokens):
            whole = self.ranks.get(t)
            if whole is not None:
                out[i] = [whole]
            elif len(t) > SHORT:
                out[i] = self._long(t)
            elif t:
                buckets.setdefault(len(t).bit_length(), []).append(i)
        for own in buckets.values():
            for s in range(0, len(own), 8192):
                for i, ids in zip(own[s : s + 8192], self._matrix([tokens[i] for i in own[s : s + 8192]]), strict=True):
                    out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, each match of the pattern on its own. Distinct matches (found by 64-bit hashes of their
        code points, then compared) are encoded once as long as they are remembered."""
        joined = "".join(texts)
        if not joined:
            return [[] for _ in texts]
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.cumsum([0, *map(len, texts)])
        if self.splitter:
            start = self.splitter.starts(points, edges[:-1][edges[:-1] < len(points)])
            end = np.r_[start[1:], len(points)]
        else:
            found = [(a + m.start(), a + m.end()) for a, t in zip(edges.tolist(), texts, strict=False) for m in self.split(t)]
            start, end = np.array(found, np.int64).reshape(-1, 2).T
        size = end - start
        start, end, size = start[size > 0], end[size > 0], size[size > 0]
        if not len(start):
            return [[] for _ in texts]
        with np.errstate(over="ignore"):
            own = np.repeat(start, size)
            at = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
            h = _mixed(points[own + at].astype(np.uint64) + (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            h = np.add.reduceat(h, np.cumsum(size) - size)

        def learn(words: list[str]) -> list[list[int]]:
            return self.encode_tokens([w.encode("utf-8", "surrogatepass") for w in words])

        ids, n = self.cache.ids(h, points, start, size, lambda i: joined[start[i] : end[i]], learn)
        upto = np.r_[0, np.cumsum(n)][np.searchsorted(start, edges)].tolist()
        ids = ids.tolist()
        return [ids[a:b] for a, b in zip(upto[:-1], upto[1:], strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=1)
def _coder(path: str, pattern: str) -> ByteBPE:
    """One a worker process, so that tasks share the pre-tokens it remembers."""
    return ByteBPE(load_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", output: str = "ids") -> DataFrame:
    """Per row: id and ids (array<int>), with output="round_trip" also text_sha256 (of the text) and decoded_sha256 (of
    the ids decoded again), or with output="digests": n_tokens, ids_sha256, decoded_sha256.

    path and pattern name the vocabulary (ranks file) and the split; by default the public byte_bpe_50k and its pattern,
    loaded by each worker from its own installation. Null texts count as empty (no ids). Repeated rows and null ids
    stay; other columns are ignored. A narrow map: no shuffle; the digests are made beside the ids, of the ids decoded
    again, so that neither travels.
    """
    d = clean_rows(docs, id_col, text_col).toDF("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        import public_tokenizers

        bpe = _coder(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                texts = [t or "" for t in part.column("text").to_pylist()]
                coded = bpe.encode(texts)
                if output == "ids":
                    yield {"id": part.column("id"), "ids": coded}
                elif output == "round_trip":
                    yield {
                        "id": part.column("id"),
                        "ids": coded,
                        "text_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts],
                        "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in coded],
                    }
                else:
                    name = bpe.names.__getitem__
                    yield {
                        "id": part.column("id"),
                        "n_tokens": [len(x) for x in coded],
                        "ids_sha256": [hashlib.sha256(" ".join(map(name, x)).encode()).hexdigest() for x in coded],
                        "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in coded],
                    }

    columns = {"ids": "ids array<int>", "round_trip": "ids array<int>, text_sha256 string, decoded_sha256 string"}.get(output, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return map_arrow(d, run, f"id {d.schema['id'].dataType.simpleString()}, {columns}").withColumnRenamed("id", id_col)


def decode_documents(coded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and text_bytes (binary), the bytes that the ids stand for; null ids give null, no ids give no bytes.
    Repeated rows and null row ids stay, other columns are ignored, an empty table gives an empty result; an id that the
    ranks don't have is an error."""
    d = clean_rows(coded, id_col, ids_col).toDF("id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        import public_tokenizers

        ranks = load_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        back = {r: b for b, r in ranks.items()}
        for batch in batches:
            yield {"id": batch.column("id"), "text_bytes": [None if x is None else b"".join(map(back.__getitem__, x)) for x in batch.column("ids").to_pylist()]}

    return map_arrow(d, run, f"id {d.schema['id'].dataType.simpleString()}, text_bytes binary").withColumnRenamed("id", id_col)
