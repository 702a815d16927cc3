"""A generalised additive model with pairwise interactions, boosted from shallow trees into lookup tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clean_rows, fresh_name, map_arrow, pieces
from .minhash import WordHashes
from .rules import measures

FEATURES = ("log_words", "word_chars", "symbols", "dup_lines", "repeats", "next_equal", "upper", "shouts", "words_a_line", "distinct", "digits", "stops", "bars")
#: Labelled rows that a model is fitted on at most: those of the least hashes of the id.
SAMPLE = 20_000


def features(text: str | None, hashes: WordHashes) -> tuple[float, ...]:
    """From the text alone; zeros for an empty one."""
    n, chars, symbols, dup, repeated, lines, upper, letters, shouts, equal = measures(text, hashes)
    if not n:
        return (0.0,) * len(FEATURES)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    digits = sum(map(data.count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9")))
    stops = sum(map(data.count, (b".", b",", b"?", b";", b":")))
    return (np.log1p(n), chars / n, symbols / n, dup / max(lines, 1), repeated / n, equal / n, upper / max(letters, 1), shouts / n, n / max(lines, 1), len(set(words)) / n, digits / n, stops / n, data.count(b"|") / n)


class AdditiveModel:
    """Bins per feature, one table a feature and one a pair; the score is the sum of the tables' entries at the bins."""

    def __init__(self, bins: int = 48, rounds: int = 120, pairs: int = 8, pair_rounds: int = 40, pair_bins: int = 16, rate: float = 0.1, leaves: int = 3, ridge: float = 2.0) -> None:
        self.max_bins, self.rounds, self.n_pairs, self.pair_rounds, self.pair_bins = bins, rounds, pairs, pair_rounds, pair_bins
        self.rate, self.leaves, self.ridge = rate, leaves, ridge
        self.base, self.edges, self.tables, self.pairs = 0.0, [], [], []

    @staticmethod
    def _edges(x: np.ndarray, bins: int) -> np.ndarray:
        """Cuts half way between neighbours at the quantiles; values of few kinds get a bin each."""
        values = np.unique(x)
        if len(values) > bins:
            values = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1), method="nearest"))
        return (values[1:] + values[:-1]) / 2

    def _tree(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Values of a tree of a few leaves over ordered bins with gradient sums g and curvature sums h."""
        cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]

        def part(a: int, b: int) -> tuple[float, int]:
            """The gain of the best cut of bins a to b and its place."""
            if b - a < 2:
                return 0.0, a
            lg, lh = cg[a + 1 : b] - cg[a], ch[a + 1 : b] - ch[a]
            rg, rh = cg[b] - cg[a + 1 : b], ch[b] - ch[a + 1 : b]
            gain = lg**2 / (lh + self.ridge) + rg**2 / (rh + self.ridge) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + self.ridge)
            i = int(gain.argmax())
            return float(gain[i]), a + 1 + i

        leaves = [(0, len(g))]
        for _ in range(self.leaves - 1):
            (gain, at), k = max((part(*leaf), i) for i, leaf in enumerate(leaves))
            if gain <= 1e-9:
                break
            a, b = leaves.pop(k)
            leaves += [(a, at), (at, b)]
        out = np.empty(len(g))
        for a, b in leaves:
            out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + self.ridge)
        return out

    def _quadrants(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """The best tree that cuts one feature, then each side by the other: its gain and values on the grid."""
        best, values = 0.0, np.zeros(g.shape)
        for flip in (False, True):
            a, b = (g.T, h.T) if flip else (g, h)
            ca, cb = np.cumsum(a, 0), np.cumsum(b, 0)
            for i in range(len(a) - 1):
                out, gain = np.empty(a.shape), 0.0
                for rows, sg, sh in ((slice(0, i + 1), ca[i], cb[i]), (slice(i + 1, None), ca[-1] - ca[i], cb[-1] - cb[i])):
                    lg, lh = np.cumsum(sg), np.cumsum(sh)
                    score = lg[:-1] ** 2 / (lh[:-1] + self.ridge) + (lg[-1] - lg[:-1]) ** 2 / (lh[-1] - lh[:-1] + self.ridge)
                    j = int(score.argmax())
                    gain += float(score[j])
                    out[rows, : j + 1] = lg[j] / (lh[j] + self.ridge)
                    out[rows, j + 1 :] = (lg[-1] - lg[j]) / (lh[-1] - lh[j] + self.ridge)
                if gain > best:
                    best, values = gain, (out.T if flip else out)
        return best, values

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        rate = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(rate / (1 - rate)))
        self.edges = [self._edges(x[:, j], self.max_bins) for j in range(x.shape[1])]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        if not len(y) or y.min() == y.max():
            return self
        at = [np.searchsorted(e, x[:, j]) for j, e in enumerate(self.edges)]
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):  # each feature in turn
            for b, table in zip(at, self.tables, strict=True):
                p = 1 / (1 + np.exp(-f))
                step = self.rate * self._tree(np.bincount(b, y - p, len(table)), np.bincount(b, p * (1 - p), len(table)))
                table += step
                f += step[b]
        coarse = [self._edges(x[:, j], self.pair_bins) for j in range(x.shape[1])]
        ca = [np.searchsorted(e, x[:, j]) for j, e in enumerate(coarse)]

        def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-f))
            shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
            flat = ca[i] * shape[1] + ca[j]
            return tuple(np.bincount(flat, w, shape[0] * shape[1]).reshape(shape) for w in (y - p, p * (1 - p)))

        usable = [j for j, e in enumerate(coarse) if len(e)]
        ranked = sorted(((self._quadrants(*grid(i, j))[0], i, j) for i in usable for j in usable if i < j), reverse=True)
        self.pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in ranked[: self.n_pairs]]
        for _ in range(self.pair_rounds):
            for i, j, _, _, table in self.pairs:
                step = self.rate * self._quadrants(*grid(i, j))[1]
                table += step
                f += step[ca[i], ca[j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for j, (e, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            f += table[np.searchsorted(e, x[:, j])]
        for i, j, a, b, table in self.pairs:
            f += table[np.searchsorted(a, x[:, i]), np.searchsorted(b, x[:, j])]
        return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def in_holdout(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2: never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> AdditiveModel:
    """The model of at most `sample` labelled documents outside the holdout; their features come to the driver, no text.

    Null labels and labels without a document don't count; of several for one document the least does. Without
    labels, or with labels of one kind alone, the model is the (smoothed) rate.
    """
    one = clean_rows(labels, id_col, label_col).toDF("_id", "_y").where("_id is not null and _y is not null").where(~in_holdout(F.col("_id"))).groupBy("_id").agg(F.min("_y").alias("_y"))
    # a label without a document takes no place; ids alone meet here
    ids = clean_rows(docs, id_col).toDF("id")
    one = one.join(ids, F.col("id") == F.col("_id"), "left_semi")
    # at most `sample` pairs of an id and a label, so a broadcast is bounded whatever the tables' size
    chosen = one.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    d = clean_rows(docs, id_col, text_col).toDF("id", "text").join(F.broadcast(chosen), F.col("id") == F.col("_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes = WordHashes()
        for batch in batches:
            for part in pieces(batch, "text"):
                yield {"h": part.column("_id"), "y": part.column("_y"), "x": [features(t, hashes) for t in part.column("text").to_pylist()]}

    found = map_arrow(d.select("_id", F.col("_y").cast("double").alias("_y"), "text"), run, f"h {d.schema['_id'].dataType.simpleString()}, y double, x array<double>")
    rows = found.orderBy(F.xxhash64("h"), "h", "x").limit(sample).collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return AdditiveModel().fit(x, np.array([float(r["y"] >= 1) for r in rows]))


def scored(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False, score_col: str = "score") -> DataFrame:
    """Per row: id and score_col (0 to 1; null and empty texts too), or with keep_columns all columns and then score_col,
    or score_col with underscores where the table has a column of that name.

    A narrow map; the model is a few lookup tables of fixed size. Repeated rows and null ids stay, an empty table gives
    an empty result, and texts are read whole.
    """
    d = docs if keep_columns else clean_rows(docs, id_col, text_col)
    names, score = [c for c in d.columns if keep_columns or c == id_col], fresh_name(d.columns if keep_columns else [id_col], score_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes = WordHashes()
        for batch in batches:
            for part in pieces(batch, text_col):
                x = np.array([features(t, hashes) for t in part.column(text_col).to_pylist()], float)
                yield {**{c: part.column(c) for c in names}, score: model.score(x)}

    return map_arrow(d, run, T.StructType([*(d.schema[c] for c in names), T.StructField(score, T.DoubleType())]))
