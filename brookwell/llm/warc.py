"""WARC archives from a chunked record table: payloads travel as (record, chunk number) rows with running digests."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import clean_rows, fresh_dir, map_arrow, materialize, open_read, open_write, spread_join

#: Levels of compression: of chunks on their way (zstd), of archives (gzip).
PACK, GZIP = 3, 6
#: Bytes of a payload chunk (about), of an archive before the next one begins.
CHUNK, ARCHIVE = 1 << 20, 1 << 30
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of all records unless one is given: archives of one table are the same bytes whenever written.
DATE = "2000-01-01T00:00:00Z"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunk_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """rid, page_id, url, chunk_no, data (a zstd frame), digest (SHA-1 of the payload so far), check (of another kind),
    done (bytes so far), last: a row for each chunk of a page's payload, one row with an empty frame for an empty one.

    rid is unique in the table as it is written; chunks are cut from the text, so a payload is never encoded whole.
    Repeated rows and rows with a null id are records of their own; an empty table gives an empty one.
    """
    d = clean_rows(pages, id_col, url_col, text_col).toDF("page_id", "url", "html")
    names = ("rid", "page_id", "url", "chunk_no", "data", "digest", "check", "done", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rid = TaskContext.get().partitionId() << 33
        pack = zstandard.ZstdCompressor(level=PACK).compress
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, text = (batch.column(c)[i].as_py() for c in ("page_id", "url", "html"))
                text, sha, check, done = text or "", hashlib.sha1(), hashlib.blake2b(digest_size=16), 0
                for no, at in enumerate(range(0, max(len(text), 1), chunk)):
                    data = text[at : at + chunk].encode("utf-8", "surrogatepass")
                    sha.update(data)
                    check.update(data)
                    done += len(data)
                    rows.append((rid, page_id, url, no, pack(data), base32(sha.digest()), check.digest(), done, at + chunk >= len(text)))
                    held += len(data)
                    if held > 8 << 20:
                        yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))
                        rows, held = [], 0
                rid += 1
        if rows:
            yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    return materialize(map_arrow(d, run, "rid long, page_id long, url string, chunk_no int, data binary, digest string, check binary, done long, last boolean"), "chunks")


def roles(chunks: DataFrame, least_bytes: int = 0) -> DataFrame:
    """rid, payload_bytes, payload_digest, record_type, refers_to: of records with equal payloads of at least
    least_bytes the one with the smallest page_id is the response, the others revisit it; smaller ones are responses.

    Payloads are equal if length, SHA-1 and BLAKE2b are. A null page_id comes after all others; of records with one id
    the first of the chunk table does. A payload that very many records have is spread over tasks. An empty table gives
    an empty result.
    """
    heads = chunks.where("last").select("rid", "page_id", F.col("done").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "check")
    key = ["payload_digest", "check", "payload_bytes"]
    first = heads.where(F.col("payload_bytes") >= least_bytes).groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "rid")).alias("value"))
    of = spread_join(heads, first, key, heads.count(), "rid")
    again = F.col("value").isNotNull() & (F.col("value.rid") != F.col("rid"))
    return of.select("rid", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("value.page_id")).alias("refers_to"), F.when(again, F.col("value.rid")).alias("refers_rid"))


def record_id(rid: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'record:{rid}')}>"


class ArchiveWriter:
    """One WARC/1.1 file, a gzip member a record; a payload comes chunk by chunk."""

    def __init__(self, uri: str) -> None:
        self.uri, self.out, self.n = uri, open_write(uri), 0
        self.size, self.member = 0, None

    def begin(self, rid: int, page_id: int | None, url: str | None, kind: str, payload_bytes: int, digest: str, refers_rid: int | None, refers_to: int | None) -> None:
        """The header; page_id and payload length stand in extension fields, as a revisit has no payload of its own."""
        fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(rid)), ("WARC-Date", DATE), ("WARC-Target-URI", "".join((url or "").splitlines())), ("WARC-Payload-Digest", f"sha1:{digest}")]
        if page_id is not None:
            fields.append(("X-Page-ID", str(page_id)))
        fields.append(("X-Payload-Length", str(payload_bytes)))
        if kind == "revisit":
            fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_rid))]
            if refers_to is not None:
                fields.append(("X-Refers-To-Page-ID", str(refers_to)))
        length = len(HTTP_HEAD) + (payload_bytes if kind == "response" else 0)
        fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(length))]
        self.raw = io.BytesIO()
        self.member = gzip.GzipFile(fileobj=self.raw, mode="wb", compresslevel=GZIP, mtime=0)
        self.member.write(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + HTTP_HEAD)

    def write(self, data: bytes) -> None:
        self.member.write(data)
        self._flush()

    def _flush(self) -> None:
        self.size += self.out.write(self.raw.getvalue())
        self.raw.seek(0)
        self.raw.truncate()

    def end(self) -> None:
        self.member.write(b"\r\n\r\n")
        self.member.close()
        self._flush()
        self.n, self.member = self.n + 1, None

    def close(self) -> None:
        self.out.close()


def write_archives(chunks: DataFrame, of: DataFrame, archive: int = ARCHIVE, folder: str | None = None) -> DataFrame:
    """Archives in the folder (by default one that goes with the application); the manifest as a table: uri, n_records.

    Chunks are dealt by rid to a fixed number of tasks, so that no plan and no split of a file parts those of a record;
    roles meet them there. A revisit brings its first row alone. A task checks that a record's chunks run on without a
    gap. Each attempt of a task writes files of its own and the manifest, committed by Spark, names those that count.
    Repeated rows of the pages are records of their own; an empty table writes no archive.
    """
    spark = chunks.sparkSession
    folder = (folder or fresh_dir(spark, "warc")).rstrip("/")
    rows = chunks.select("rid", "page_id", "url", "chunk_no", "data", "last").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rid")
    rows = rows.join(of, "rid").where("record_type = 'response' or chunk_no = 0")
    rows = rows.withColumn("data", F.when(F.col("record_type") == "response", F.col("data")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        made: list[tuple[str, int]] = []
        unpack = zstandard.ZstdDecompressor().decompress
        out: ArchiveWriter | None = None
        begun: tuple[int, int] | None = None  # the record that is being written, and its next chunk
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if (begun or (r["rid"], 0)) != (r["rid"], r["chunk_no"]):
                    raise ValueError(f"chunk {r['chunk_no']} of record {r['rid']} comes where {begun or 0} is due")
                if r["chunk_no"] == 0:
                    if out and out.size >= archive:
                        out.close()
                        made.append((out.uri, out.n))
                        out = None
                    out = out or ArchiveWriter(f"{folder}/{uuid.uuid4().hex}.warc.gz")
                    out.begin(r["rid"], r["page_id"], r["url"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_rid"], r["refers_to"])
                if r["data"]:
                    out.write(unpack(r["data"]))
                begun = (r["rid"], r["chunk_no"] + 1)
                if r["last"] or r["record_type"] == "revisit":
                    out.end()
                    begun = None
        if begun:
            raise ValueError(f"record {begun[0]} ends before its last chunk")
        if out:
            out.close()
            made.append((out.uri, out.n))
        yield {"uri": [u for u, _ in made], "n_records": [n for _, n in made]}

    return materialize(map_arrow(rows.sortWithinPartitions("rid", "chunk_no"), run, "uri string, n_records long"), "archives")


def read_records(uri: str, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], Callable[[], Iterator[bytes]]]]:
    """Headers of each record (names in lower case) and a function that streams its block; what isn't read is skipped."""
    raw = open_read(uri)
    with gzip.GzipFile(fileobj=raw, mode="rb") as f:
        buffered = io.BufferedReader(f, 1 << 16)
        while line := buffered.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{uri}: no record where one should begin")
            head: dict[str, str] = {}
            while line := buffered.readline().rstrip(b"\r\n"):
                name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
                head[name.lower()] = value.strip()
            left = int(head["content-length"])

            def block() -> Iterator[bytes]:
                nonlocal left
                while left and (data := buffered.read(min(left, chunk))):
                    left -= len(data)
                    yield data

            yield head, block
            for _ in block():
                pass
    raw.close()


def payload(block: Iterator[bytes]) -> Iterator[bytes]:
    """A block's bytes after its HTTP header."""
    held = b""
    for data in block:
        held += data
        head, found, rest = held.partition(b"\r\n\r\n")
        if found:
            yield rest
            yield from block
            return


def read_archives(manifest: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Per record: page id, payload_bytes, payload_digest, record_type, refers_to. A response's length and digest are
    made anew from its payload and must agree with its header; a revisit has them in its header. A row a record, repeated
    ones too; an empty manifest gives an empty result. A payload is read as a stream, however long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                rows: list[tuple] = []
                for head, block in read_records(uri):
                    n, digest = int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response":
                        sha, done = hashlib.sha1(), 0
                        for data in payload(block()):
                            sha.update(data)
                            done += len(data)
                        if (done, base32(sha.digest())) != (n, digest):
                            raise ValueError(f"{uri}: {head['warc-record-id']} isn't what its header says")
                    whole = [int(head[k]) if k in head else None for k in ("x-page-id", "x-refers-to-page-id")]
                    rows.append((whole[0], n, digest, head["warc-type"], whole[1]))
                    if len(rows) == 10_000:
                        yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))
                        rows = []
                if rows:
                    yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = manifest.select("uri", F.row_number().over(Window.orderBy("uri")).alias("at")).repartitionById(parts, F.col("at") % parts)  # a row an archive
    return map_arrow(dealt, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long").withColumnRenamed("page_id", id_col)


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages' archives and read them back. Null html is an empty payload; a null url an empty one; null ids stay
    null and repeated rows are records of their own. Other columns are ignored; an empty table writes no archive."""
    chunks = chunk_table(pages)
    return read_archives(write_archives(chunks, roles(chunks, least_bytes)))
