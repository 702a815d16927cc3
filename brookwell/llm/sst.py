"""Token ids as sorted-string-table shards: prefix-compressed blocks, sparse block index, Bloom filter, footer."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import RaggedCache, clean_rows, fresh_dir, map_arrow, materialize, open_read, open_write, pieces

MAGIC = b"BWSST\x00\x01\n"
FOOTER = struct.Struct("<QQQQQI8s")  # index at, index bytes, bloom at, bloom bytes, documents, hashes, magic
ENTRY = struct.Struct("<BBI")  # bytes of the key shared with the one before, own bytes, bytes of the value
BLOCK = 256 << 10
BITS_PER_KEY, HASHES = 10, 7
#: Bytes of text that go to a shard (about), and shards at most; a shard is written as a stream, however large.
SHARD, SHARDS = 128 << 20, 20_000


def key_of(doc_id: int | None) -> bytes:
    """Nine bytes in the order of the ids, null first."""
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _bits(key: bytes, m: int, hashes: int) -> Iterator[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return ((a + i * b) % m for i in range(hashes))


class ShardWriter:
    """Writes one shard; keys must come in order. Holds one block, the index and the keys' hashes."""

    def __init__(self, uri: str) -> None:
        self.out = open_write(uri)
        self.at, self.n = 0, 0
        self.block, self.last, self.first = bytearray(), b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []  # distinct ones
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, value: bytes) -> None:
        key = key_of(doc_id)
        if not self.block:
            self.first, self.last = key, b""
        shared = len(os.path.commonprefix((key, self.last)))
        self.block += ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        if key != self.last or not self.keys:
            self.keys.append(key)
        self.last, self.n = key, self.n + 1
        if len(self.block) >= BLOCK:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            data = self.pack(bytes(self.block))
            self.index.append((self.first, self.at, len(data)))
            self._put(data)
            self.block = bytearray()

    def close(self) -> None:
        self._end_block()
        index_at = self.at
        self._put(b"".join(k + struct.pack("<QI", at, n) for k, at, n in self.index))
        m = max(64, len(self.keys) * BITS_PER_KEY)
        bloom = bytearray((m + 7) // 8)
        for k in self.keys:
            for b in _bits(k, m, HASHES):
                bloom[b >> 3] |= 1 << (b & 7)
        bloom_at = self.at
        self._put(struct.pack("<Q", m) + bytes(bloom))
        self._put(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, self.at - bloom_at, self.n, HASHES, MAGIC))
        self.out.close()


class ShardReader:
    """Reads a shard: in order, block by block, or one key by Bloom filter and binary search."""

    def __init__(self, uri: str) -> None:
        self.file = open_read(uri)
        self.file.seek(0, 2)
        end = self.file.tell()
        index_at, index_n, bloom_at, bloom_n, self.n, self.hashes, magic = FOOTER.unpack(self._read(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        index = self._read(index_at, index_n)
        self.index = [(index[i : i + 9], *struct.unpack("<QI", index[i + 9 : i + 21])) for i in range(0, len(index), 21)]
        bloom = self._read(bloom_at, bloom_n)
        self.m, self.bloom = struct.unpack("<Q", bloom[:8])[0], bloom[8:]
        self.unpack = zstandard.ZstdDecompressor().decompress

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        data, at, key = self.unpack(self._read(*self.index[i][1:])), 0, b""
        while at < len(data):
            shared, own, n = ENTRY.unpack_from(data, at)
            at += ENTRY.size
            key = key[:shared] + data[at : at + own]
            yield key, data[at + own : at + own + n]
            at += own + n

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for i in range(len(self.index)):
            for key, value in self._block(i):
                yield id_of(key), value

    def get(self, doc_id: int | None) -> list[bytes]:
        """Values of the id, as many as documents bear it."""
        key = key_of(doc_id)
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bits(key, self.m, self.hashes)):
            return []
        low, high = 0, len(self.index)
        while low < high:  # the first block that begins at or after the key; the one before may hold it too
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        out = []
        for i in range(max(low - 1, 0), len(self.index)):
            if self.index[i][0] > key:
                break
            out += [v for k, v in self._block(i) if k == key]
        return out

    def close(self) -> None:
        self.file.close()


#: Classes of bytes: 0 blanks that chunks are cut at, 1 ASCII letters, 2 ASCII symbols but for the apostrophe, 3 others.
_CLASS = np.array([0 if c in b" \t\n\r" else 1 if chr(c).isalpha() and c < 128 else 2 if 33 <= c < 127 and not chr(c).isalnum() and c != 39 else 3 for c in range(256)], np.uint8)
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Random numbers by place and byte: the sum over a chunk's bytes is its hash.
_PLACES = 64
_TABLE = np.random.Generator(np.random.PCG64(20240502)).integers(0, 2**64, _PLACES * 256, np.uint64)


class ChunkEncoder:
    """Token ids of texts by the tokenizers library, each distinct chunk encoded once as long as it is remembered.

    The vocabulary drops white space and no token spans it, so a text's ids are those of its chunks in turn; letters
    come in lower case, and a symbol after a letter begins a pre-token, so texts are cut there as well. Cutting, hashing
    and putting ids together are array operations over many texts. Chunks are found by 64-bit hashes from a random
    table, then compared. A text with a special token's name in it goes to the library whole.
    """

    def __init__(self, path: str, most: int = 700_000) -> None:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.encode, self.cache = library.encode_batch_fast, RaggedCache(most)
        self.special = [t.content.lower().encode() for t in library.get_added_tokens_decoder().values()]
        self.ends = np.zeros(library.get_vocab_size() + 1, bool)
        self.ends[[i for t, i in library.get_vocab().items() if t.endswith("</w>")]] = True

    def _learn(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks. Those of Latin letters alone go to the library as lines of many: each is one pre-token, whose
        last id, and no other, is marked as a word's end. Below U+0250 nothing composes, and lower case goes letter by
        letter but for one capital."""
        out: list[list[int]] = [[]] * len(chunks)
        plain = [k for k, c in enumerate(chunks) if c.isalpha() and max(c) < "\u0250" and "\u0130" not in c]
        alone = {*range(len(chunks))} - {*plain}
        rows = [plain[i : i + 1024] for i in range(0, len(plain), 1024)]
        for own, e in zip(rows, self.encode([" ".join(map(chunks.__getitem__, r)) for r in rows], add_special_tokens=False), strict=True):
            ids, start = e.ids, 0
            ends = (np.flatnonzero(self.ends[np.array(ids, np.int64)]) + 1).tolist()
            if len(ends) != len(own):
                alone |= {*own}
                continue
            for k, end in zip(own, ends, strict=True):
                out[k], start = ids[start:end], end
        rest = sorted(alone)
        for i in range(0, len(rest), 4096):
            own = rest[i : i + 4096]
            for k, e in zip(own, self.encode([chunks[k] for k in own], add_special_tokens=False), strict=True):
                out[k] = e.ids
        return out

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (null: none) as little-endian 32-bit integers."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or offsets[0] == offsets[-1]:
            return [b""] * len(texts)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        kind = _CLASS[data]
        solid = kind != 0
        if not solid.any():
            return [b""] * len(texts)
        begin = np.ones(len(data), bool)
        begin[1:] = ~solid[:-1] | ((kind[:-1] == 1) & (kind[1:] == 2))
        begin[offsets[:-1][offsets[:-1] < len(data)]] = True
        begin &= solid
        folded = _FOLD[data[solid]]
        start = np.flatnonzero(begin[solid])
        size = np.diff(np.r_[start, len(folded)])
        place = np.minimum(np.arange(len(folded)) - np.repeat(start, size), _PLACES - 1)
        h = np.add.reduceat(_TABLE[(place << 8) | folded], start)
        raw = folded.tobytes()
        for w in np.flatnonzero(size > _PLACES).tolist():
            h[w] = xxhash.xxh3_64_intdigest(raw[start[w] : start[w] + size[w]])
        flat, n = self.cache.ids(h, np.frombuffer(raw, np.uint8), start, size, lambda i: raw[start[i] : start[i] + size[i]].decode("utf-8", "surrogatepass"), self._learn)
        ids = flat.astype("<u4").tobytes()
        edges = np.r_[0, np.cumsum(n)][np.searchsorted(np.flatnonzero(begin), offsets)].tolist()
        out = [ids[4 * a : 4 * b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        low = _FOLD[data].tobytes()
        if any(t in low for t in self.special):
            for k in range(len(texts)):
                if any(t in low[offsets[k] : offsets[k + 1]] for t in self.special):
                    out[k] = np.array(self.encode([texts[k].as_py()], add_special_tokens=False)[0].ids, "<u4").tobytes()
        return out


@lru_cache(maxsize=1)
def _encoder(path: str) -> ChunkEncoder:
    """One a worker process, so that tasks share what they have learnt."""
    return ChunkEncoder(path)


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, folder: str | None = None) -> DataFrame:
    """Encode, append end_id to each document, write shards in ascending order of ids to the folder (by default one that
    goes with the application); the manifest as a table: shard, uri, first_key, last_key (see key_of), n_docs, n_ids,
    start (ids in shards before it).

    Null texts count as empty: the end id alone. Documents with one id stand together, in the order of a hash of their
    text, then of their ids' bytes; a null id comes first. Only id and text are read. An empty table gives no shards.

    There are as many shards as tasks of a shuffle, more where a shard would get over SHARD bytes of text. Bounds between
    them come from approximate quantiles of the id alone, so the token ids move once; an id with so many documents that
    it stands at several bounds has its documents dealt to the shards between these by the hash. Each attempt of a task
    writes files of its own, and the manifest (a table, committed by Spark) names those that count.
    """
    spark = docs.sparkSession
    d = clean_rows(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    folder = (folder or fresh_dir(spark, "sst")).rstrip("/")
    if not (n := shards or 0):
        n_bytes = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = min(SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // SHARD)))
    least = F.coalesce("doc_id", F.lit(-(1 << 63)))
    found = d.agg(F.percentile_approx(least, [i / n for i in range(1, n)] or [0.5], max(10_000, 4 * n))).first()[0] or []
    bounds = np.array(found if n > 1 else [], np.int64)
    d = d.withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 20)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = _encoder(path or public_tokenizers.path("word_bpe_49k.json"))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                ids = part.column("doc_id")
                known = np.array([-(1 << 63) if i is None else i for i in ids.to_pylist()], np.int64)
                at, to = (np.searchsorted(bounds, known, side) for side in ("left", "right"))
                shard = at + (part.column("h").to_numpy() * np.maximum(to - at, 1) >> 20)
                yield {"shard": shard.astype(np.int32), "doc_id": ids, "h": part.column("h"), "ids": [x + end for x in coder(part.column("text"))]}

    coded = map_arrow(d, encode, "shard int, doc_id long, h long, ids binary")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        writer, at, uri, size = None, None, "", 0
        made: list[tuple[int, str, bytes, bytes, int, int]] = []

        def end() -> None:
            if writer:
                writer.close()
                made.append((at, uri, writer.keys[0], writer.keys[-1], writer.n, size))

        for batch in batches:
            for shard, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "ids")), strict=True):
                if shard != at:
                    end()
                    at, size, uri = shard, 0, f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.sst"
                    writer = ShardWriter(uri)
                writer.add(doc_id, ids)
                size += len(ids) // 4
        end()
        names = ("shard", "uri", "first_key", "last_key", "n_docs", "n_ids")
        yield dict(zip(names, map(list, zip(*made, strict=True)) if made else ([] for _ in names), strict=True))

    ordered = coded.repartitionById(n, "shard").sortWithinPartitions("shard", "doc_id", "h", "ids")
    manifest = materialize(map_arrow(ordered, write, "shard int, uri string, first_key binary, last_key binary, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_shards(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document of the shards: id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers). Documents
    that were repeated come as often; an empty manifest gives an empty result. A shard is read block by block."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = ShardReader(uri)
                rows: list[tuple] = []
                for doc_id, value in shard:
                    rows.append((doc_id, start, len(value) // 4, zlib.crc32(value)))
                    start += len(value) // 4
                    if len(rows) == 20_000:
                        yield dict(zip(("doc_id", "start", "n_tokens", "ids_crc32"), map(list, zip(*rows, strict=True)), strict=True))
                        rows = []
                shard.close()
                if rows:
                    yield dict(zip(("doc_id", "start", "n_tokens", "ids_crc32"), map(list, zip(*rows, strict=True)), strict=True))

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(manifest.select("shard", "uri", "start").repartitionById(parts, F.col("shard") % parts), read, "doc_id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("doc_id", id_col)


def lookup(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id and ids (array<int>) of the documents whose id is among those wanted: a row a document, several where
    several bear the id, none for an unknown one. Ids that are wanted more than once count once; null finds null.

    The manifest (a row a shard, SHARDS at most) comes to the driver; a wanted id is dealt to the shards whose key range
    it lies in, one but for an id that fills several, and only these are opened. There Bloom filter and index say which
    block to read, if any.
    """
    shards = manifest.select("shard", "uri", "first_key", "last_key").orderBy("shard").collect()
    uris, first, last = [s.uri for s in shards], [bytes(s.first_key) for s in shards], [bytes(s.last_key) for s in shards]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows: list[tuple[int, int | None]] = []
            for i in batch.column("doc_id").to_pylist():
                key = key_of(i)
                at = bisect_left(last, key)
                while at < len(first) and first[at] <= key:
                    rows.append((at, i))
                    at += 1
            yield {"at": [a for a, _ in rows], "doc_id": [i for _, i in rows]}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, shard = None, None
        for batch in batches:
            for own, i in zip(batch.column("at").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
                if own != at:
                    if shard:
                        shard.close()
                    at, shard = own, ShardReader(uris[own])
                if found := shard.get(i):
                    yield {"doc_id": [i] * len(found), "ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in found]}
        if shard:
            shard.close()

    ids = clean_rows(wanted, id_col).toDF("doc_id").select(F.col("doc_id").cast("long")).distinct()
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = map_arrow(ids, deal, "at int, doc_id long").repartition(parts, "at").sortWithinPartitions("at", "doc_id")
    return map_arrow(dealt, read, "doc_id long, ids array<int>").withColumnRenamed("doc_id", id_col)
