import base64
import hashlib

import pytest
import zstandard

from brookwell.llm import common, warc

KIND = "page_id long, url string, html string, data string, rid string"


def rows():
    big = "é" * 300_000 + "\r\n\r\nWARC/1.1\r\n" + "x" * 5000
    out = [(5, "http://a/5", "<p>same</p>"), (2, "http://a/2\r\nX: y", "<p>same</p>"), (9, None, "<p>same</p>"), (1, "http://a/1", None), (3, "http://a/3", ""), (4, "http://b", big), (8, "http://c", big + "!"), (7, "u", big)]
    return [(i, u, h, "clash", "clash") for i, u, h in [*out, (6, "u", "\r\n\r\n"), (6, "u", "\r\n\r\n"), (None, "u", "alone"), (None, "u", "<p>same</p>")]]


def expected(rows, least=0):
    first, out = {}, []
    for i, _, h, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (h or "").encode()
        again = len(data) >= least and data in first
        out.append(str((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[data] if again else None)))
        first.setdefault(data, i)
    return sorted(out)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc.chunk_table, "__defaults__", ("page_id", "url", "html", 70_000))
    for least in (0, 5):
        got = warc.archived(spark.createDataFrame(rows(), KIND), least).collect()
        assert sorted(str(tuple(r)) for r in got) == expected(rows(), least)


def test_chunks_carry_running_digests(spark):
    text = "ab" * 1000
    found = sorted(warc.chunk_table(spark.createDataFrame([(1, "u", text, "", "")], KIND), chunk=300).collect(), key=lambda r: r.chunk_no)
    assert b"".join(zstandard.decompress(bytes(r.data)) for r in found) == text.encode() and len(found) == 7
    for r in found:
        assert r.digest == base64.b32encode(hashlib.sha1(text[: r.done].encode()).digest()).decode()
    assert [r.last for r in found] == [False] * 6 + [True]


def test_archives_roll_over_and_read_as_warc(spark):
    chunks = warc.chunk_table(spark.createDataFrame(rows(), KIND))
    manifest = warc.write_archives(chunks, warc.roles(chunks), archive=100).collect()
    assert len(manifest) > 4 and sum(m.n_records for m in manifest) == len(rows())
    heads = [h for m in manifest for h, _ in warc.read_records(m.uri)]
    assert all(h["warc-record-id"].startswith("<urn:uuid:") and h["warc-date"] for h in heads)
    ids = {h["warc-record-id"] for h in heads}
    assert len(ids) == len(rows()) and all(h["warc-refers-to"] in ids for h in heads if h["warc-type"] == "revisit")


def test_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], KIND)).collect() == []


def test_chunks_of_a_record_in_several_splits(spark, monkeypatch):
    """Payloads of over a hundred chunks in small row groups, read in small splits, with a broadcast join of the roles."""
    monkeypatch.setattr(warc.chunk_table, "__defaults__", ("page_id", "url", "html", 20_000))
    jvm = spark.sparkContext._jsc.hadoopConfiguration()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    jvm.set("parquet.block.size", "65536")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        import random

        rng = random.Random(1)
        noise = ["".join(map(chr, (rng.randrange(33, 5000) for _ in range(50_000)))) for _ in range(4)]
        big = [(i, "u", "".join(rng.choice(noise) for _ in range(44)), "", "") for i in range(4)] + [(9, "u", "small", "", "")]
        chunks = warc.chunk_table(spark.createDataFrame([*big, (10, "u", big[2][2], "", "")], KIND))
        assert chunks.rdd.getNumPartitions() > 3 and chunks.where("rid = 0").count() + chunks.where("page_id = 2").count() > 100
        got = warc.read_archives(warc.write_archives(chunks, warc.roles(chunks))).collect()
        assert sorted(str(tuple(r)) for r in got) == expected([*big, (10, "u", big[2][2])])
    finally:
        jvm.unset("parquet.block.size")
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_lost_chunk_is_an_error(spark):
    chunks = warc.chunk_table(spark.createDataFrame([(1, "u", "abc" * 1000, "", "")], KIND), chunk=500)
    for gone in ("chunk_no = 2", "chunk_no = 0", "last"):
        with pytest.raises(Exception, match="chunk"):
            warc.write_archives(chunks.where(f"not ({gone})"), warc.roles(chunks))


@pytest.mark.parametrize("plain", [0, 1 << 20])
def test_a_payload_that_most_records_have(spark, monkeypatch, plain):
    monkeypatch.setattr(common, "PLAIN", plain)
    many = [(i, "u", "the same" if i % 3 else f"own {i}", "", "") for i in range(3000)]
    got = warc.archived(spark.createDataFrame(many, KIND)).collect()
    assert sorted(str(tuple(r)) for r in got) == expected(many)
