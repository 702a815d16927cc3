"""Small corpora with the awkward cases in them, and brute-force versions of the contracts."""

import random
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, nulls, empties, repeated rows, one long text."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    texts = [words(rng, rng.randrange(1, 120)) for _ in range(n)]
    texts += [texts[3], texts[3], texts[5]]
    for _ in range(12):  # edits of one base, some near enough, some not
        w = texts[7].split() if len(texts[7].split()) > 40 else words(random.Random(9), 90).split()
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(w))
    texts += [words(rng, 20) + "\n" + passage + "\n" + words(rng, 20) for _ in range(4)]
    texts += [None, "", "   \n\t ", "one", "Ünï çödé 😀 " * 30, passage.upper(), "ab " * 200, words(rng, 6000)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "no id here at all but words enough to matter", "en", "a", 0)]
    rng.shuffle(rows)
    return rows


def table(spark, rows, extra=True):
    """With columns beside, whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for c in ("key", "size", "score", "bucket", "spans", "id", "kept", "n"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def components(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def repeated_bytes(texts, length):
    """For each text, which bytes lie in a string of length bytes that starts elsewhere too."""
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                hit[i : i + length] = [True] * length
        out.append(hit)
    return out
