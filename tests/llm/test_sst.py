import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from brookwell.llm import sst

from .helpers import corpus, table


def test_shard_round_trip(tmp_path, monkeypatch):
    monkeypatch.setattr(sst, "BLOCK", 400)
    items = [(None, b"null"), (-5, b""), (-1, b"a" * 900), (0, b"x"), (7, b"first"), (7, b"second")]
    items += [(10 + i, bytes([i % 251]) * (i % 40)) for i in range(500)] + [((1 << 62), b"far")]
    w = sst.ShardWriter(f"file://{tmp_path}/one.sst")
    for k, v in items:
        w.add(k, v)
    w.close()
    r = sst.ShardReader(f"file://{tmp_path}/one.sst")
    assert [*r] == items and r.n == len(items) and len(r.index) > 5
    assert r.get(7) == [b"first", b"second"] and r.get(None) == [b"null"] and r.get(1 << 62) == [b"far"]
    assert all(v in r.get(k) for k, v in items)
    assert not any(r.get(k) for k in range(100_000, 100_500))
    r.close()


def test_equal_keys_over_several_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(sst, "BLOCK", 50)
    w = sst.ShardWriter(str(tmp_path / "two.sst"))
    for i in range(40):
        w.add(3, bytes([i]) * 20)
    w.close()
    assert len(sst.ShardReader(str(tmp_path / "two.sst")).get(3)) == 40


def test_chunks_encode_like_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), sst.ChunkEncoder(path)
    texts = ["", "Hello,  WORLD's\tcafé\r\n  x", "á ́b", "Σίσυφος ΣΑΣ", "\x1c\x1d a b　c\x85d", "<|endoftext|> <|startoftext|>x", "日本語 テキスト 12345", "😀" * 50, " \n ", "don't x.'s a!b'c I\u0307 \u0130X ab\u0301.", "y" * 300 + "!" * 99, "<|STARTOFTEXT|>"]
    assert [np.frombuffer(b, "<u4").tolist() for b in own(pa.array(texts))] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_table(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus()
    got = sst.read_shards(sst.write_shards(table(spark, rows))).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    texts, start = {r[0]: r[1] or "" for r in rows}, 0
    for r in got:
        ids = np.array([*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert sst.read_shards(sst.write_shards(table(spark, []))).collect() == []


def test_lookup_opens_one_shard(spark, monkeypatch):
    rows = [(3 * i, f"word{i} and more", "en", "a", 0) for i in range(200)] + [(9, "another text", "en", "a", 0), (None, "no id", "en", "a", 0)]
    manifest = sst.write_shards(table(spark, rows), shards=5)
    assert manifest.agg({"n_docs": "sum"}).first()[0] == len(rows) and manifest.count() == 5
    wanted = spark.createDataFrame([(9, "x"), (300, "x"), (300, "x"), (301, "x"), (10**12, "x"), (None, "x")], "doc_id long, ids string")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(str((r[0], [*library.encode(r[1], add_special_tokens=False).ids, 2])) for r in rows if r[0] in (9, 300, None))
    assert sorted(str((r.doc_id, r.ids)) for r in sst.lookup(manifest, wanted).collect()) == want
    keys = [(bytes(m.first_key), bytes(m.last_key)) for m in manifest.orderBy("shard").collect()]
    assert all(sum(a <= sst.key_of(i) <= b for a, b in keys) <= 1 for i in range(0, 600))
    assert sst.lookup(manifest, wanted.limit(0)).collect() == [] == sst.lookup(sst.write_shards(table(spark, [])), wanted).collect()


def test_an_id_that_most_documents_have(spark):
    """Null or not, its documents go to several shards and stay in order."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} of many", "en", "a", 0) for i in range(600)]
    manifest = sst.write_shards(table(spark, rows), shards=9)
    sizes = [m.n_docs for m in manifest.collect()]
    assert len(sizes) > 6 and max(sizes) < 150
    got = sst.read_shards(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert len(sst.lookup(manifest, spark.createDataFrame([(7,)], "doc_id long")).collect()) == 200
