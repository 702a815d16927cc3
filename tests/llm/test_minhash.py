import random

import numpy as np
import pytest

from brookwell.llm import common, graph, minhash

from .helpers import components, corpus, shingles, table, words


def expected(rows, percent=75):
    sets = [shingles(t) for _, t, *_ in rows]
    n = range(len(rows))
    same = [(i, j) for i in n for j in n if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = components(same, n)
    least = {}
    for i in n:
        if rows[i][0] is not None:
            least[root[i]] = min(least.get(root[i], rows[i][0]), rows[i][0])
    return sorted(str((rows[i][0], len(sets[i]), c, c == rows[i][0])) for i in n for c in [least.get(root[i])])


def test_groups_are_exact(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in minhash.near_duplicates(table(spark, rows)).collect())
        assert got == expected(rows)


@pytest.mark.parametrize("seed, plain", [(4, 0), (5, 1 << 20)])
def test_large_groups_in_blocks(spark, monkeypatch, seed, plain):
    """Near copies in more than one block, in buckets and in clusters."""
    monkeypatch.setattr(minhash, "SKETCH_BLOCK", 8)
    monkeypatch.setattr(minhash, "SET_BLOCK", 4)
    monkeypatch.setattr(minhash, "STAR", 7)
    monkeypatch.setattr(minhash, "HUBS", 3)
    monkeypatch.setattr(common, "PLAIN", plain)
    rng = random.Random(seed)
    base = words(rng, 80).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(80)] = f"y{rng.randrange(999)}"
        rows.append((i, " ".join(w), "en", "a", 0))
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in minhash.near_duplicates(table(spark, rows)).collect())
    assert got == expected(rows)


def test_chain_of_edits(spark, monkeypatch):
    """Each text is near the next alone: most of the cluster stays open after the star."""
    monkeypatch.setattr(minhash, "SET_BLOCK", 4)
    w, rows = words(random.Random(6), 100, 10_000).split(), []
    for i in range(40):
        w[(2 * i) % 100] = f"z{i}"
        rows.append((i, " ".join(w), "en", "a", 0))
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in minhash.near_duplicates(table(spark, rows)).collect())
    assert got == expected(rows) and {r[2] for r in map(eval, got)} == {0}


@pytest.mark.parametrize("percent", [50, 90])
def test_other_similarities(spark, percent):
    """No pair is lost at a least similarity for which the sketch and its bands are others."""
    rng = random.Random(percent)
    rows = []
    for k in range(40):
        base = words(rng, 60, 10_000).split()
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(60)] = f"y{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(w), "en", "a", 0))
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in minhash.near_duplicates(table(spark, rows), percent=percent).collect())
    assert got == expected(rows, percent)
    for wrong in (0, 101):
        with pytest.raises(ValueError):
            minhash.near_duplicates(table(spark, rows), percent=wrong)


def near_copies(n, seed=3):
    rng = random.Random(seed)
    base, rows = words(rng, 100, 10_000).split(), []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(100)] = f"y{rng.randrange(9999)}"
        rows.append((i, " ".join(w), "en", "a", 0))
    return rows


def test_a_cluster_of_near_copies_moves_rows_in_proportion(spark, monkeypatch):
    """Rows that a cluster's search sends to its tasks, at two sizes."""
    monkeypatch.setattr(minhash, "SKETCH_BLOCK", 32)
    monkeypatch.setattr(minhash, "SET_BLOCK", 32)
    moved = []
    plain = minhash.map_arrow

    def counted(df, fn, schema):
        if "hub" in df.columns or "bi" in df.columns:
            moved[-1] += df.count()
        return plain(df, fn, schema)

    monkeypatch.setattr(minhash, "map_arrow", counted)
    for n in (200, 800):
        moved.append(0)
        got = minhash.near_duplicates(spark.createDataFrame(near_copies(n), "doc_id long, text string, lang string, source string, n_chars long")).collect()
        assert {r.component_id for r in got} == {0}, n
    assert moved[1] < 5 * moved[0], moved


def test_null_ids_and_repeated_rows_make_no_pairs(spark):
    """A third of the rows has no id, another third is one row."""
    rng = random.Random(8)
    rows = [(None, words(rng, 30, 10_000), "en", "a", 0) for _ in range(100)]
    rows += [(5, words(rng, 30, 10_000), "en", "a", 0)] * 100 + [(6, rows[0][1], "en", "a", 0), (9, None, "en", "a", 0)] + [(None, None, "en", "a", 0)] * 40
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in minhash.near_duplicates(table(spark, rows)).collect())
    assert got == expected(rows)


def test_empty_table(spark):
    assert minhash.near_duplicates(table(spark, [])).collect() == []


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 400, np.uint64))
    union = np.r_[a, rng.integers(0, 2**63, 100, np.uint64)]
    sk = minhash.sketches([a, union, a[:1], a[:3]], 1024)
    assert (sk != np.iinfo(np.uint64).max).all()
    assert abs((sk[0] == sk[1]).mean() - 0.8) < 0.06
    assert (minhash.sketches([a], 1024)[0] == sk[0]).all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 6), (6, 5), (7, 7)], "a long, b long")
    found = {r.v: r.root for r in graph.components(edges).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, 5: 5, 6: 5}
    assert graph.components(edges.limit(0)).collect() == []


@pytest.mark.parametrize("plain", [0, 1 << 20])
def test_components_with_a_hub(spark, monkeypatch, plain):
    """One vertex with most of the links: its key comes by broadcast."""
    monkeypatch.setattr(common, "PLAIN", plain)
    rng = random.Random(2)
    links = [(7, i) for i in range(1000, 4000)] + [(i, i + 1) for i in range(5000, 5050)] + [(rng.randrange(6000, 9000), rng.randrange(6000, 9000)) for _ in range(1500)]
    found = {r.v: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components(links, {x for e in links for x in e if e[0] != e[1]})
    assert found == want


@pytest.mark.parametrize("plain", [0, 1 << 20])
def test_spread_join(spark, monkeypatch, plain):
    from pyspark.sql import functions as F

    from brookwell.llm.common import spread_join

    monkeypatch.setattr(common, "PLAIN", plain)
    left = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, F.col("id")).alias("k"))
    right = left.where("k is not null and k % 2 = 0").groupBy("k").agg(F.count("*").alias("n")).withColumn("value", F.struct((F.col("k") * 2).alias("twice")))
    out = spread_join(left, right, ["k"], 5000, "id").collect()
    assert len(out) == 5000
    for r in out:
        assert (r.value.twice if r.value else None) == (2 * r.k if r.k is not None and r.k % 2 == 0 else None)
