import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from brookwell.llm import gam

from .helpers import corpus, table, words


def test_main_effects_and_a_pair():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = gam.AdditiveModel().fit(x[:3000], y[:3000])
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    assert (m.pairs[0][0], m.pairs[0][1]) == (0, 1)
    y = (x[:, 2] > 0.3).astype(float)
    assert ((gam.AdditiveModel(pairs=0).fit(x[:3000], y[:3000]).score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.98


def test_one_kind_of_label():
    m = gam.AdditiveModel().fit(np.zeros((10, len(gam.FEATURES))), np.ones(10))
    assert np.allclose(m.score(np.ones((2, len(gam.FEATURES)))), 11 / 12)
    assert gam.AdditiveModel().fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((1, 3)))[0] == 0.5


def docs_and_labels():
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        text = " ".join(["same"] * 40) if bad and i % 2 else " ".join(w + ("%%%" if bad else "") for w in words(rng, 40).split())
        rows.append((i, text, "en", "a", 0))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = docs_and_labels()
    d = table(spark, rows)
    model = gam.fit(d, spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0), (777_777, 0, 0)], "doc_id long, quality int, toxic int"))
    got = gam.scored(d, model).withColumn("held_out", gam.in_holdout(F.col("doc_id"))).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 50 and all((r.score >= 0.7) == (r.doc_id % 3 != 0) for r in held)


def test_labels_without_a_document_take_no_place(spark):
    rows, labels = docs_and_labels()
    d, kind = table(spark, rows), "doc_id long, quality int, toxic int"
    strangers = [(10_000 + i, i % 2, 0) for i in range(4000)]
    a, b = (gam.fit(d, spark.createDataFrame(x, kind), sample=250) for x in (labels, labels + strangers))
    assert len(a.pairs) == len(b.pairs) > 0 and all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))


def test_holdout_is_never_learned_from(spark):
    rows, labels = docs_and_labels()
    d = table(spark, rows)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    kind = "doc_id long, quality int, toxic int"
    a, b = (gam.fit(d, spark.createDataFrame(x, kind)) for x in (labels, turned))
    assert all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))


def test_odd_rows(spark):
    rows, labels = docs_and_labels()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = gam.fit(table(spark, rows), marks)
    got = gam.scored(table(spark, corpus()), model, keep_columns=True).collect()
    assert len(got) == len(corpus()) and all(0 <= r.score_ <= 1 for r in got) and got[0].score == "clash"
    assert gam.scored(table(spark, []), model).collect() == []
    none = gam.fit(table(spark, []), marks.limit(0))
    assert [r.score for r in gam.scored(table(spark, [(1, None, "en", "a", 0)]), none).collect()] == [0.5]


def slow_score(model, x):
    """The model read as it stands: for each feature the entry of the bin that the value lies in, added up."""

    def bin_of(edges, v):
        return sum(1 for e in edges if e < v)

    f = model.base
    for j, table_ in enumerate(model.tables):
        f += table_[bin_of(model.edges[j], x[j])]
    for i, j, a, b, grid in model.pairs:
        f += grid[bin_of(a, x[i])][bin_of(b, x[j])]
    return 1 / (1 + np.exp(-f))


def test_scores_are_sums_of_entries():
    rng = np.random.default_rng(4)
    x = np.round(rng.random((500, 4)) * 20) / 20
    m = gam.AdditiveModel(rounds=20, pair_rounds=10).fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float))
    probe = rng.random((50, 4)) * 1.4 - 0.2
    assert np.allclose(m.score(probe), [slow_score(m, p) for p in probe], atol=1e-12)


def gain_of(parts, ridge):
    return sum(sum(g) ** 2 / (sum(h) + ridge) for g, h in parts)


def test_trees_are_the_best_cuts():
    """The first cut of a tree and the quadrants of a pair against a search of all cuts."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = int(rng.integers(2, 8))
        g, h = rng.normal(size=n), rng.random(n) + 0.1
        m = gam.AdditiveModel(leaves=2)
        best = max(range(1, n), key=lambda i: gain_of([(g[:i], h[:i]), (g[i:], h[i:])], m.ridge))
        if gain_of([(g[:best], h[:best]), (g[best:], h[best:])], m.ridge) - gain_of([(g, h)], m.ridge) > 1e-6:
            want = [sum(g[:best]) / (sum(h[:best]) + m.ridge)] * best + [sum(g[best:]) / (sum(h[best:]) + m.ridge)] * (n - best)
            assert np.allclose(m._tree(g, h), want)
        a, b = int(rng.integers(2, 5)), int(rng.integers(2, 5))
        g, h = rng.normal(size=(a, b)), rng.random((a, b)) + 0.1
        found = 0.0
        for x, y in ((g, h), (g.T, h.T)):
            for i in range(1, len(x)):
                halves = [max(gain_of([(p[:, :j].ravel(), q[:, :j].ravel()), (p[:, j:].ravel(), q[:, j:].ravel())], m.ridge) for j in range(1, x.shape[1])) for p, q in ((x[:i], y[:i]), (x[i:], y[i:]))]
                found = max(found, sum(halves))
        assert np.isclose(m._quadrants(g, h)[0], found)
