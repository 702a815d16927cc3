"""Quality rules with risk-controlled cutoffs: exact binomial bounds on labelled holdouts, per stratum."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, lgamma, log, log1p, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clean_rows, map_arrow, materialize, pieces
from .minhash import WordHashes, window_hashes

SYMBOLS = b"#*$%&|<>"
_OTHERS = bytes(b for b in range(256) if b not in SYMBOLS)
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_LETTER = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0))
_NOT_SHOUT = bytes(b for b in range(256) if b != 33)


def measures(text: str | None, hashes: WordHashes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_letters, n_shouts, n_next_equal."""
    if not text:
        return (0,) * 10
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    repeated = 0
    if len(words) > 5:
        h = window_hashes(words, hashes, 5)
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        if len(count) < len(h):
            edge = np.zeros(len(words) + 1, np.int64)
            at = np.flatnonzero(count[back] > 1)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + 5, -1)
            repeated = int((np.cumsum(edge) > 0).sum())
    blanks = sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    return (
        len(words), len(text) - blanks, len(data.translate(None, _OTHERS)), len(lines) - len(set(lines)), repeated, len(lines),
        len(data.translate(None, _NOT_UPPER)), len(data.translate(None, _NOT_LETTER)), len(data.translate(None, _NOT_SHOUT)),
        sum(map(bytes.__eq__, words, words[1:])),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shouts", "n_next_equal")


@dataclass(frozen=True)
class Rule:
    """Documents whose ratio is at or over a cutoff fail; the ratio falls into bins of width 1 / steps, the last open."""

    name: str
    ratio: str
    steps: int
    bins: int


#: Only these ratios; each is 0 for a document without what it counts.
RULES = (
    Rule("symbols", "n_symbols / n_words", 50, 100),
    Rule("dup_lines", "n_dup_lines / n_lines", 50, 51),
    Rule("repeats", "n_repeat_words / n_words", 50, 51),
    Rule("next_equal", "n_next_equal / n_words", 50, 51),
    Rule("upper", "n_upper / n_letters", 50, 51),
    Rule("shouts", "n_shouts / n_words", 50, 100),
    Rule("long_words", "word_chars / n_words", 5, 150),
)


def log_binomial(rejected: int, n: int, p: float) -> float:
    """log P(X <= rejected) of n draws at a rate p above rejected / n: the terms fall from the last one on, so those of a
    few widths of the distribution hold all that a double can."""
    terms = min(rejected, int(60 * sqrt(n * p * (1 - p))) + 60)
    k = np.arange(rejected, rejected - terms, -1, dtype=np.float64)
    ratios = np.log(k) + log1p(-p) - np.log(n - k + 1) - log(p)  # of the term at k - 1 to that at k
    last = lgamma(n + 1) - lgamma(rejected + 1) - lgamma(n - rejected + 1) + rejected * log(p) + (n - rejected) * log1p(-p)
    return last + log1p(float(np.exp(np.cumsum(ratios)).sum()))


def binomial_upper(rejected: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the rate at which so few rejections out of n have probability delta (upper bound at 1 - delta)."""
    if n == 0 or rejected >= n:
        return 1.0
    low, high = rejected / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if mid <= 0 or mid >= 1 or log_binomial(rejected, n, mid) > log(delta):
            low = mid
        else:
            high = mid
    return high


def most_rejected(n: int, most: float, delta: float) -> int:
    """The greatest number of rejections out of n for which the upper bound is at most `most`; -1 if there is none."""
    low, high = -1, int(n * most)
    while low < high:
        mid = (low + high + 1) // 2
        if mid < n * most and log_binomial(mid, n, most) <= log(delta):
            low = mid
        else:
            high = mid - 1
    return low


def choose_cutoff(good: np.ndarray, bad: np.ndarray, most: float, delta: float, price: float = 20.0, share: float = 0.02) -> int | None:
    """A bin to cut at (bins at and over it fail), or None. good and bad: labelled documents in each bin.

    From the most lenient cutoff on, up to the first whose bound on false rejection goes over most; delta is shared by
    all cutoffs, so their bounds hold at once, and most may depend on the same documents. Of these cutoffs, the one is
    taken that rejects most bad documents after a price for each good one, and more than a share of them; of equals the
    most lenient.
    """
    n, best, at = int(good.sum()), share * int(bad.sum()), None
    allowed = most_rejected(n, most, delta / max(1, len(good) - 1)) if 0 < most < 1 else -1 if most <= 0 else n
    lost, caught = 0, 0
    for i in range(len(good) - 1, 0, -1):
        lost, caught = lost + int(good[i]), caught + int(bad[i])
        if lost > allowed:
            break
        if caught - price * lost > best:
            best, at = caught - price * lost, i
    return at


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str, most: float, delta: float, id_col: str, label_col: str) -> dict[tuple[str | None, str], int]:
    """(stratum, rule) -> the bin to cut at, from documents that pass the base. The rules come in turn: each is tested
    on all good documents, and chosen by the bad ones that no rule before it rejects.

    Bonferroni: delta is shared by all pairs of a stratum and a rule and by the rule's cutoffs, so all bounds hold at
    once. A stratum's rules share most: each has what the bounds of the cutoffs chosen before it leave, so that what all
    of them together reject is bounded by most, however the rules overlap. What comes to the driver is a count per stratum,
    bin and label, rule by rule, so strata should be few (languages); a stratum without enough labelled good documents
    for any certificate gets no cutoff, so nothing but the base rejects its documents.
    """
    one = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_good")).where("_id is not null and _good is not null").groupBy("_id").agg(F.min("_good").alias("_good"))
    held = measured.where(~base_fails()).join(one, F.col(id_col) == F.col("_id"))
    held = held.select(F.col(stratum).alias("s"), (F.col("_good") >= 1).alias("good"), *MEASURES)
    least = ceil(log(delta / len(RULES)) / log1p(-most)) if 0 < most < 1 else 1
    strong = held.where("good").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("s").alias("strong"))
    held = materialize(held.join(strong, F.col("s").eqNullSafe(F.col("strong"))).drop("strong"), "held")
    strata = [r[0] for r in held.select("s").distinct().collect()]
    out: dict[tuple[str | None, str], int] = {}
    if not strata:
        return out
    own, left = delta / max(1, len(strata) * len(RULES)), dict.fromkeys(strata, most)
    for rule in RULES:
        caught = [F.col("s").eqNullSafe(F.lit(s)) & (bin_of(r) >= out[s, r.name]) for r in RULES for s in strata if (s, r.name) in out]
        rest = held.where(F.col("good") | ~reduce(operator.or_, caught, F.lit(False)))
        counts = {s: np.zeros((2, 1 + rule.bins), np.int64) for s in strata}
        for s, good, at, n in rest.groupBy("s", "good", bin_of(rule).alias("bin")).count().collect():
            counts[s][int(good), at] += n
        for s, (bad, good) in counts.items():
            if (cut := choose_cutoff(good, bad, left[s], own)) is not None:
                out[s, rule.name] = cut
                left[s] -= binomial_upper(int(good[cut:].sum()), int(good.sum()), own / rule.bins)
    return out


def base_fails() -> Column:
    """Fewer than ten words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def bin_of(rule: Rule) -> Column:
    top, low = rule.ratio.split(" / ")
    return F.least(F.floor(F.when(F.col(low) > 0, F.col(top) * rule.steps / F.col(low)).otherwise(0.0)), F.lit(rule.bins)).cast("int")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", most: float = 0.03, delta: float = 0.05) -> DataFrame:
    """Per document: id, the measures, base_failed, failed_rule (the first that it fails, else null) and kept.

    With probability 1 - delta over the labelled documents, the rules together reject no more than the share most of
    good documents of any stratum. Null texts measure 0 and fail the base (fewer than 10 words). Labels that are null, or of documents
    that aren't there, don't count; of several for one document the least does. Null ids match no label. A null
    stratum is one of its own. Repeated rows stay; other columns are ignored; without labels only the base rejects.

    One pass over the texts; the measures (a row a document, no text) go to the shared folder, as both the counts
    and the verdicts read them.
    """
    d = clean_rows(docs, id_col, text_col, stratum_col).toDF("id", "text", "stratum")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes = WordHashes()
        for batch in batches:
            for part in pieces(batch, "text"):
                found = [measures(t, hashes) for t in part.column("text").to_pylist()]
                yield {"id": part.column("id"), "stratum": part.column("stratum"), **dict(zip(MEASURES, map(list, zip(*found, strict=True)), strict=True))}

    kind = T.StructType([d.schema["id"], d.schema["stratum"], *(T.StructField(m, T.LongType()) for m in MEASURES)])
    measured = materialize(map_arrow(d, run, kind), "measures")
    found = cutoffs(measured, clean_rows(labels, id_col, label_col).withColumnRenamed(id_col, "id"), "stratum", most, delta, "id", label_col)
    failed = [F.when(F.col("stratum").eqNullSafe(F.lit(s)) & (bin_of(r) >= found[s, r.name]), F.lit(r.name)) for r in RULES for s in sorted({s for s, name in found if name == r.name}, key=str)]
    out = measured.withColumn("base_failed", base_fails()).withColumn("failed_rule", F.coalesce(*failed, F.lit(None).cast("string")))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull()).withColumnsRenamed({"id": id_col, "stratum": stratum_col})
