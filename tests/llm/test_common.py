import os
import tracemalloc

import numpy as np
import pytest

from brookwell.llm import common


def test_scratch_owns_what_is_written_in_it(spark):
    with common.scratch(spark):
        inner = common.fresh_dir(spark, "inner")
        assert common.materialize(spark.range(5), "five").count() == 5
        os.makedirs(inner.removeprefix("file://"))
    outer = common.materialize(spark.range(3), "three")
    assert not os.path.exists(inner.removeprefix("file://")) and outer.count() == 3
    folder = f"{common.shared_dir(spark)}/brookwell-{spark.sparkContext.applicationId}".removeprefix("file://")
    assert os.path.isdir(folder) and not [f for f in os.listdir(folder) if f.startswith(("inner", "five"))]


def test_no_folder_of_one_machine_on_a_cluster():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(lambda: Conf)

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_fresh_names():
    assert common.fresh_name(["a", "b"], "score") == "score" and common.fresh_name(["Score", "score_"], "score") == "score__"


@pytest.mark.parametrize("hashing", [lambda w: hash(w) & 0xFFFF_FFFF, lambda w: len(w), lambda w: 7])
def test_remembered_items_are_compared(hashing):
    """Also where hashes are equal, within a call and with what is remembered."""
    cache = common.RaggedCache(1000)
    for words in (["ab", "abc", "ab"], ["cd", "ab", "x"], ["cd"], ["ab"], ["y", "y"], []):
        text = "".join(words)
        size = np.array([*map(len, words)], np.int64)
        start = np.cumsum(size) - size
        symbols = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ids, n = cache.ids(np.array([*map(hashing, words)], np.uint64), symbols, start, size, lambda i, w=words: w[i], lambda ws: [[*w.encode()] for w in ws])
        assert ids.tolist() == [*text.encode()] and n.tolist() == size.tolist()


def test_remembered_items_take_little_memory():
    """A worker keeps them beside all that later stages do."""
    words = [f"{i:07x}" for i in range(50_000)]
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.full(len(words), 7)
    hashes, start = np.random.default_rng(1).permutation(len(words)).astype(np.uint64), np.cumsum(size) - size
    cache = common.RaggedCache(len(words))
    tracemalloc.start()
    try:
        for _ in range(2):
            ids, n = cache.ids(hashes, points, start, size, words.__getitem__, lambda ws: [[*w[:3].encode()] for w in ws])
        assert ids.tolist() == [*"".join(w[:3] for w in words).encode()] and set(n.tolist()) == {3}
        del ids, n
        assert tracemalloc.get_traced_memory()[0] < 100 * len(words)
    finally:
        tracemalloc.stop()
