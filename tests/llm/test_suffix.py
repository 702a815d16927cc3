import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brookwell.llm import suffix

from .helpers import corpus, repeated_bytes, table


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text("ab", max_size=40).map(str.encode)), max_size=40))
def test_deep_shallow_order(items):
    heads, strings = np.array([h for h, _ in items], np.uint64), [s for _, s in items]
    order = suffix.deep_shallow_order(heads, strings)
    assert [items[i] for i in order] == sorted(items)


def check(spark, rows, length=200):
    got = sorted((str(r.doc_id), r.n_bytes, [(s.start, s.end) for s in r.spans], r.kept_sha256) for r in suffix.repeated_spans(table(spark, rows), length=length).collect())
    texts = [(t or "").encode() for _, t, *_ in rows]
    want = []
    for (i, *_), t, hit in zip(rows, texts, repeated_bytes(texts, length), strict=True):
        edges = [k for k in range(len(t) + 1) if (k < len(t) and hit[k]) != (k > 0 and hit[k - 1])]
        want.append((str(i), len(t), [*zip(edges[::2], edges[1::2], strict=True)], hashlib.sha256(bytes(b for b, h in zip(t, hit, strict=True) if not h)).hexdigest()))
    assert got == sorted(want)


def test_spans_are_exact(spark):
    check(spark, corpus(3, 30))


@pytest.mark.parametrize("wide", [20_000, 1])
def test_edges_of_shared_passages(spark, monkeypatch, wide):
    """Passages with more or less of their surroundings in common, cut off by documents' ends, periodic, copied; by
    sorted contexts and by streamed windows."""
    monkeypatch.setattr(suffix, "WIDE", wide)
    rng = random.Random(6)

    def noise(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    passage = noise(330)
    texts = [noise(rng.randrange(80)) + passage[rng.randrange(60) : 330 - rng.randrange(60)] + noise(rng.randrange(80)) for _ in range(12)]
    texts += [passage, passage[:200], passage[1:200], passage[130:], "the " * 90, "the " * 120 + noise(40), noise(100) + "é" * 150, noise(260)]
    texts += [texts[0], texts[0] + "x", noise(190) + passage[:10], None, ""]
    check(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])


@pytest.mark.parametrize("length", [100, 33, 2])
def test_other_lengths(spark, length):
    rng = random.Random(length)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(2 * length))
    texts = ["".join(chr(rng.randrange(33, 3000)) for _ in range(30)) + shared[rng.randrange(length) :] for _ in range(8)]
    check(spark, [(i, t, "en", "a", 0) for i, t in enumerate([*texts, shared[: length - 1], shared[:length], None])], length)


def test_too_short_a_length(spark):
    with pytest.raises(ValueError):
        suffix.repeated_spans(table(spark, []), length=1)


def test_more_buckets_than_tasks(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BUCKET", 500)
    check(spark, corpus(5, 30))


def test_empty_table(spark):
    assert suffix.repeated_spans(table(spark, [])).collect() == []


def test_kept_bytes(spark):
    rows = [(1, "z" * 150 + "q" * 300, "en", "a", 0), (2, "short", "en", "a", 0)]
    got = {r.doc_id: bytes(r.kept) for r in suffix.repeated_spans(table(spark, rows), keep_bytes=True).collect()}
    assert got[2] == b"short" and got[1] == b"z" * 150
