"""The registered queries as they stand, over small tables with nulls, empty and long texts, repeated rows and clashing names."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from brookwell.llm import bpe, mixing, pii, queries

from .helpers import corpus, table
from .test_mixing import filled, sizes_of
from .test_pii import brute as personal
from .test_rules import brute as measured

CODES = "4111 1111 1111 1111, 10.0.0.1 and 300.1.1.1, mail a.b@c-d.org; +1 (234) 555-7777 GB82 WEST 1234 5698 7654 32"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = corpus(4, 50) + [(700, CODES, "en", "a", 1), (701, CODES + " \n" + "x" * 3000, None, "b", 1), (None, None, None, None, None), (None, CODES, "en", "a", 1)]
    rows += [(710, "aaa " * 40_000, "en", "c", 1), (711, "q" * 20_000, "en", "c", 1)]
    path = str(tmp_path_factory.mktemp("tables"))
    table(spark, rows).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], rng.randrange(2), 0) for r in rows] + [(9999, 1, 0), (3, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def run(spark, folder, name):
    df = queries.queries()[name](spark, folder[0])
    return df.columns, [tuple(r) for r in df.collect()]


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_op1(spark, folder):
    columns, got = run(spark, folder, "op1_pii")
    assert columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = []
    for i, text, *_ in folder[1]:
        base = personal(text or "")
        want.append((i, *(sum(k == kind for k, *_ in base) for kind in pii.BASE), sha(",".join(f"{k}:{s}:{e}" for k, s, e in base))))
    same([r[:6] for r in got], want)
    spans = {r[0]: r[6] for r in got}
    assert [s.split(":")[0] for s in spans[700].split(",")] == ["email", "ip", "card", "phone", "iban"] and spans[9] == ""
    assert all(len(r[6].split(",")) == len(r[7].split(",")) for r in got)


def test_op2(spark, folder):
    columns, got = run(spark, folder, "op2_bpe")
    assert columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, text, *_ in folder[1]:
        ids = library.encode_ordinary(text or "") if len(text or "") < 20_000 or " " in text else None
        if ids is None:  # the library takes its time over one long word; the encoder of single tokens is held against it elsewhere
            ids = bpe.ByteBPE(ranks, public_tokenizers.PATTERN)._long(text.encode())
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(text or "")))
    same(got, want)


def test_op5(spark, folder):
    """The drawn set itself, from the keys alone."""
    columns, got = run(spark, folder, "op5_mixing")
    assert columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    size = mixing.word_count(F.col("text"))
    u = (F.pmod(F.xxhash64(F.lit(17), "doc_id", "text"), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    keyed = docs.select("doc_id", "text", "source", size.alias("words"), (-F.log(u) / mixing.quality_weight(F.col("text"), size)).alias("of")).collect()
    targets, sizes, want = filled(sizes_of(folder[1])), sizes_of(folder[1]), []
    for source, target in targets.items():
        rows = sorted((r for r in keyed if r.source == source), key=lambda r: (r.of, r.doc_id is not None, r.doc_id or 0))
        epochs = int(target / sizes[source] + 1e-9) if sizes[source] else 0
        gap, extra, total, open_ = target - epochs * sizes[source], [0] * len(rows), 0, True
        for i, r in enumerate(rows):  # as far as the running sum goes
            total += r.words
            if open_ and r.words and total <= gap:
                extra[i] = 1
            open_ = total <= gap
        gap -= sum(r.words for r, x in zip(rows, extra, strict=True) if x)
        while new := fitting(rows, extra, gap):
            for i in new:
                extra[i], gap = 1, gap - rows[i].words
        left = [(abs(r.words - gap), r.of, i) for i, (r, x) in enumerate(zip(rows, extra, strict=True)) if not x and r.words and abs(r.words - gap) < gap]
        if left:
            extra[min(left)[2]] = 1
        want += [(r.doc_id, r.words, sizes[source], round(target, 6), (epochs + x) * r.words) for r, x in zip(rows, extra, strict=True)]
    same([(*r[:3], round(r[3], 6), r[4]) for r in got], want)


def fitting(rows, extra, gap):
    out, total = [], 0
    for i, (r, x) in enumerate(zip(rows, extra, strict=True)):
        if not x and 0 < r.words <= gap:
            total += r.words
            if total <= gap:
                out.append(i)
    return out


def test_op6(spark, folder):
    columns, got = run(spark, folder, "op6_sst")
    assert columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    library, ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for i, text, *_ in folder[1]:
        ids.setdefault(i, []).append(np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4"))
    start = 0
    for r in sorted(got, key=lambda r: r[1]):
        assert r[1] == start and (r[2], r[3]) in {(len(x), zlib.crc32(x.tobytes())) for x in ids[r[0]]}
        start += r[2]
    same([(r[0], r[2], r[3]) for r in got], [(i, len(x), zlib.crc32(x.tobytes())) for i, own in ids.items() for x in own])


def test_op7(spark, folder):
    columns, got = run(spark, folder, "op7_rules")
    assert columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = []
    for i, text, *_ in folder[1]:
        m = measured(text)
        want.append((i, *m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    same([r[:7] for r in got], want)
    assert not any(r[7] for r in got if r[6])


def test_op8(spark, folder):
    columns, got = run(spark, folder, "op8_gam")
    assert columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    same([r[:2] for r in got], [(r[0], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in folder[1]])
    assert all(0 <= r[2] <= 1 and r[3] == (r[2] >= 0.7) for r in got)


@pytest.mark.parametrize("name", ["op1_pii", "op2_bpe", "op5_mixing", "op6_sst", "op7_rules", "op8_gam", "op9_suffix"])
def test_empty_tables(spark, folder, tmp_path, name):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder[0]}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    df = queries.queries()[name](spark, str(tmp_path))
    assert df.collect() == [] and df.schema == queries.queries()[name](spark, folder[0]).schema


