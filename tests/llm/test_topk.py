import numpy as np
from pyspark.sql import functions as F

from brookwell.llm import topk

KIND = "vec_id long, embedding array<float>, label int, score string, rank string"


def brute(rows, k, every):
    ok = {}
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        v = [float(x) for x in np.array(v, np.float32).astype(np.float64)]
        ok[i] = min(ok.get(i, v), v)
    whole = {i: [int(x) for x in np.floor(64 * np.array(v))] for i, v in ok.items()}
    out = set()
    for q in whole:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in whole if i != q and len(whole[i]) == len(whole[q]))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "PART", 100)
    monkeypatch.setattr(topk, "FIRST", 4)
    monkeypatch.setattr(topk, "BATCH", 3)
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 8)).astype(np.float32)
    vectors[100:140] = vectors[100]
    rows = [(i, [float(x) for x in v], 0, "a", "b") for i, v in enumerate(vectors)]
    rows += [(1000, None, 0, "", ""), (1001, [None] * 8, 0, "", ""), (1020, [float("nan")] * 8, 0, "", ""), (1040, [float("inf")] * 8, 0, "", ""), (None, [1.0] * 8, 0, "", "")]
    rows += [rows[20], rows[20], (60, [0.5] * 8, 0, "", ""), (2000, [1e9] * 8, 0, "", ""), (2001, [-1e9] * 8, 0, "", ""), (2020, [0.0] * 8, 0, "", "")]
    got = {tuple(r) for r in topk.top_k(spark.createDataFrame(rows, KIND), 5, F.col("vec_id") % 20 == 0).collect()}
    assert got == brute(rows, 5, 20)


def test_fewer_rows_than_k_and_none(spark):
    rows = [(20, [1.0, 2.0], 0, "", ""), (1, [1.0, 0.0], 0, "", ""), (40, [0.0, 0.0, 0.0], 0, "", "")]
    got = {tuple(r) for r in topk.top_k(spark.createDataFrame(rows, KIND), 20, F.col("vec_id") % 20 == 0).collect()}
    assert got == {(20, 1, 1, 4096)}
    assert topk.top_k(spark.createDataFrame([], KIND), 20, F.col("vec_id") % 20 == 0).collect() == []


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 16)) * 100
    rows = np.floor(centres[rng.integers(0, 10, 2000)] + rng.normal(size=(2000, 16)) * 3)
    block = topk.PivotBlock(np.arange(2000), rows)
    bounds = np.array([*block.bounds(rows[:50])])
    scores = rows[:50] @ block.rows.T
    assert (bounds >= scores).all()
    kth = np.sort(scores, axis=1)[:, -20]
    assert (bounds >= kth[:, None]).mean() < 0.15


def test_clustered_vectors_go_in_the_order_of_their_bounds():
    """The k best over several blocks, most of it without a look at the other rows."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 100
    rows = np.floor(centres[rng.integers(0, 12, 4000)] + rng.normal(size=(4000, 16)) * 3)
    ids, found = np.arange(4000), [(np.empty(0, np.int64), np.empty(0, np.int64))] * 40
    blocks = [topk.PivotBlock(ids[s : s + 1000], rows[s : s + 1000]) for s in range(0, 4000, 1000)]
    for b in blocks:
        b.search(ids[:40], rows[:40], 20, found)
    scores = (rows[:40] @ rows.T).astype(np.int64)
    for q, (i, v) in enumerate(found):
        want = sorted((-scores[q, x], x) for x in range(4000) if x != q)[:20]
        assert [*zip((-v).tolist(), i.tolist(), strict=True)] == want
    assert not any(b.in_products for b in blocks) and sum(b.in_order for b in blocks) < 0.2 * 40 * 4000


def test_wide_vectors_and_large_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=3000) * (1e3 if i % 2 else 1e-2))], 0, "", "") for i in range(60)]
    rows += [(100, [], 0, "", ""), (120, [], 0, "", "")]
    got = {tuple(r) for r in topk.top_k(spark.createDataFrame(rows, KIND), 5, F.col("vec_id") % 20 == 0).collect()}
    assert got == brute(rows, 5, 20)
