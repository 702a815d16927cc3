import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from brookwell.llm import bpe, gam, pii

from .helpers import DOCS, components, shingles, words

LABELS = "doc_id long, quality int, toxic int"
#: Columns beside, named like those that the stages make on their way.
OTHERS = ("k1", "k2", "_row", "_id", "_null", "_copies", "_own", "_copy", "_score", "score", "row", "at", "own", "copies", "class", "value", "_salt", "n")


def beside(df):
    return df.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in OTHERS})


@pytest.fixture
def folder(spark, tmp_path):
    """Good and bad documents, copies, edits, personal data, repeated rows, a null id."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        text = words(rng, 40, 5000)
        if i % 10 == 3:
            text = " ".join(w + "$$$" for w in text.split())
        elif i % 10 == 5:
            w = rows[i - 1][1].split()
            w[rng.randrange(40)] = "edit"
            text = " ".join(w)
        elif i % 10 == 6:
            text = rows[i - 2][1]
        elif i % 10 == 7:
            text += f" mail u{i}@example.com or +1 (234) 555-{7000 + i}"
        rows.append((i, text, "en", "ab"[i % 2] if i % 7 else None, len(text)))
        labels.append((i, 0 if i % 10 == 3 else 1, 0))
    rows += [rows[0], rows[1], (None, words(rng, 40, 5000), "en", "a", 1)]
    beside(spark.createDataFrame(rows, DOCS)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows


def test_stages_by_brute_force(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, path)
        if name != "tokens":
            assert df.schema == docs.schema
        df.write.parquet(f"{path}/{name}")
        before, docs = docs, spark.read.parquet(f"{path}/{name}")
        got = docs.collect()
        if name != "tokens":
            assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in got for c in OTHERS)
        out[name] = [tuple(r)[: len(got[0]) if name == "tokens" else 5] for r in got]
    model = gam.fit(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    scores = {r.doc_id: r.score for r in gam.scored(spark.createDataFrame(rows, DOCS), model).collect()}
    good = [r for r in rows if scores[r[0]] >= corpus_pipeline.LEAST_SCORE]
    assert sorted(map(str, out["quality"])) == sorted(map(str, good)) and {r[0] % 10 for r in rows if r not in good} == {3}
    sets = {r[0]: shingles(r[1]) for r in good}
    ids = [i for i in sets if i is not None]
    root = components([(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])], ids)
    kept = {r for r in good if r[0] is None or root[r[0]] == r[0]}
    assert sorted(map(str, out["near_dedup"])) == sorted(map(str, kept)) and len(kept) < len(good) - 50
    clean = {r[0]: pii.redact(r[1], pii.find_spans(r[1])) for r in kept}
    assert sorted(map(str, out["personal_data"])) == sorted(str((r[0], clean[r[0]], r[2], r[3], len(clean[r[0]]))) for r in kept)
    assert not any("@" in t for t in clean.values())
    count = {}
    for r in out["mixing"]:
        assert r in out["personal_data"]
        count[r[0]] = count.get(r[0], 0) + 1
    assert max(count.values()) <= 3
    assert abs(len(out["mixing"]) - len(kept)) <= 3
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted(map(str, out["tokens"])) == sorted(str((r[0], library.encode_ordinary(r[1]))) for r in out["mixing"])
    assert before.count() == docs.count()


def test_run_gives_the_last_stage(spark, folder):
    path, _ = folder
    got = corpus_pipeline.run(spark, path)
    assert got.columns == ["doc_id", "ids"] and got.count() > 100


def test_repeated_rows_share_their_copies(spark, tmp_path):
    rows = [(1, "a b c d e f g h i j", "en", "x", 1)] * 4 + [(2, "k l m n o p q r s t", "en", "y", 1)]
    got = corpus_pipeline.mixed(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sum(r.doc_id == 2 for r in got) in (1, 2) and 3 <= sum(r.doc_id == 1 for r in got) <= 4


def test_near_dedup_keeps_one_row_of_each_group(spark):
    """Also where all ids of a group are null, and where an id stands on texts of several groups."""
    one, two, three, four = (words(random.Random(k), 60, 5000) for k in range(4))
    rows = [(None, one, "en", "a", 1), (None, one + " more", "en", "a", 1), (None, one, "en", "a", 1)]
    rows += [(3, two, "en", "a", 1), (5, two + " more", "en", "a", 1), (5, three, "en", "a", 1), (6, three, "de", "b", 1), (None, three, "en", "a", 1)]
    rows += [(7, four, "en", "a", 1), (7, four + " more", "en", "a", 1), (8, None, "en", "a", 1), (None, "", "en", "a", 1), (None, "", "en", "a", 1)]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()]
    assert len(got) == 6
    assert sum(i is None and t.startswith(one) for i, t in got if t) == 1 and sum(i == 7 and t.startswith(four) for i, t in got if t) == 1
    assert {(3, two), (5, three), (8, None), (None, "")} < set(got)


def test_tokens_are_decoded_again(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c", "en", "x", 5), (None, None, "en", "x", 0), (2, "Ünï 😀", "en", "x", 5)], DOCS)
    assert {r.doc_id: len(r.ids) > 0 for r in corpus_pipeline.tokens(spark, docs, "").collect()} == {1: True, None: False, 2: True}
    plain = bpe.encode_documents

    def broken(docs, **how):
        out = plain(docs, **how)
        return out.withColumn("decoded_sha256", F.lit("another text")) if "decoded_sha256" in out.columns else out

    monkeypatch.setattr(bpe, "encode_documents", broken)
    with pytest.raises(Exception, match="don't decode to its text"):
        corpus_pipeline.tokens(spark, docs, "").collect()


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
