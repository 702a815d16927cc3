"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, clean_rows, materialize, materialize_counted

#: Fixed values of the mix: the sources' weights in turn, and how often a source may be repeated at most.
WEIGHTS, REPEATS = (5.0, 2.0, 1.0), 3.0
#: Symbols that prose has few of.
SYMBOLS = r"[#*$%&|<>{}\\^~]"
#: Documents of a stretch of keys of a source, within which one task makes the exact running sum.
STRETCH = 4_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = REPEATS) -> DataFrame:
    """source, source_size, n, target of (source, source_size, n).

    The weights are dealt to the sources by code point, null last. A source that would go over most * its size stops
    there and the excess goes to the others by weight, until none is above: target = least(cap, level * weight), and
    the level follows from the sources in the order of cap / weight. The table has one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("i", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("turn", F.col("cap") / F.col("weight"))
    up = Window.orderBy("turn", "i")
    total = F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("total", total).withColumn("level", (total - before) / after)
    # from the first source that isn't filled at its level on, that level holds for all
    s = s.withColumn("open", F.when(F.col("turn") > F.col("level"), F.col("level")))
    s = s.withColumn("level", F.min_by("open", F.when(F.col("open").isNotNull(), F.struct("turn", "i"))).over(Window.partitionBy()))
    return s.select("source", "source_size", "n", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).cast("double").alias("target"))


def row_keys(doc_id: str | Column, text: str | Column, seed: int = 17) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row's id and text, never null: what a mixed row and its document are matched by."""
    return F.xxhash64(doc_id, text), F.xxhash64(text, doc_id, F.lit(seed))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """A document's weight from 1/16 to 1: less for words far from usual length (runs without blanks, single letters) and
    for many symbols a word."""
    words = F.greatest(size, F.lit(1))
    mean, symbols = F.length(text) / words, F.regexp_count(text, F.lit(SYMBOLS)) / words
    usual = F.when(mean.between(3.5, 12), 1.0).when(mean.between(2.5, 20), 0.5).otherwise(0.25)
    return usual * F.when(symbols < 0.1, 1.0).when(symbols < 0.5, 0.5).otherwise(0.25)


def _weight_classes(d: DataFrame) -> DataFrame:
    """source and classes: an array of (share of the source's documents, mean weight) for weights near each other.

    Classes are half powers of two between 2 ** -20 and 2 ** 20, so there are 81 at most, whatever the weights are.
    """
    near = F.round(2 * F.log2("weight"))
    one = d.groupBy("source", F.greatest(F.lit(-40), F.least(F.lit(40), near)).alias("near")).agg(F.count("*").alias("n"), F.avg("weight").alias("mean"))
    found = one.groupBy("source").agg(F.sum("n").alias("all"), F.collect_list(F.struct("n", "mean")).alias("of"))
    return found.select("source", F.transform("of", lambda c: F.struct((c["n"] / F.col("all")).alias("share"), c["mean"].alias("mean"))).alias("classes"))


def _summed(d: DataFrame, most: Column | None = None) -> DataFrame:
    """With sum, the running sum of sizes in the order of a source's keys; stretches that begin at most or over it are left out."""
    sums = d.groupBy("source", "stretch").agg(F.sum("size").alias("sum"))
    # the table of stretches has a row for STRETCH documents or so: a source with many goes in rows of its own below
    upto = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("stretch").alias("t"), F.coalesce(F.sum("sum").over(upto), F.lit(0)).alias("before"))
    d = d.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("stretch") == F.col("t"))).drop("s", "t")
    if most is not None:
        d = d.where(F.col("before") < most)
    within = Window.partitionBy("source", "stretch").orderBy("key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("sum", F.col("before") + F.sum("size").over(within)).drop("before")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = REPEATS, seed: int = 17, weight: Column | None = None) -> DataFrame:
    """Per document: id, source, size, source_size, target, copies (times that the mix holds it), taken = copies * size,
    and k1, k2 (see row_keys).

    Each document has the key -ln(u) / weight with u from a hash of seed, id and text; each source takes its whole
    epochs first, then documents in the order of their keys as long as the running sum of sizes stays within the rest,
    then, again in that order, those further on that fit what is missing, until none does, then the one document left
    over whose size comes nearest to what is missing, if that makes the miss smaller.
    Sizes count words; a null text has size 0. Ties of keys (repeated rows) go by row; reruns agree up to which of
    several equal rows it is. Null ids and sources are values of their own. Other columns are ignored; an empty
    table gives an empty result.

    No source is held in one task: keys of a source fall into stretches by the law of its keys (exponential, a part for
    each of its weights), their sums are added up in a small table, and running sums are made within a stretch. A weight
    that is null or not above 1e-6 counts as 1e-6.
    """
    d = clean_rows(docs, id_col, text_col, source_col).toDF("doc_id", "text", "source")
    size = word_count(F.col("text"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    own = F.greatest(F.coalesce(quality_weight(F.col("text"), size) if weight is None else weight, F.lit(0.0)), F.lit(1e-6)).cast("double")
    d = d.select("doc_id", "source", *(k.alias(n) for k, n in zip(row_keys("doc_id", "text"), ("k1", "k2"), strict=True)), size.alias("size"), own.alias("weight"), (-F.log(u)).alias("key"))
    d = materialize(d.withColumn("key", F.col("key") / F.col("weight")).withColumn("row", F.monotonically_increasing_id()), "sized")
    plan = targets(d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, most)
    plan = plan.join(_weight_classes(d).withColumnRenamed("source", "c"), F.col("source").eqNullSafe(F.col("c"))).drop("c")
    plan = plan.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    # a ratio a hair under a whole number is that number
    plan = plan.withColumn("epochs", F.floor(F.col("ratio") + 1e-9)).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    d = d.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    stretches = F.ceil(F.col("n") / F.lit(STRETCH))
    before = F.aggregate("classes", F.lit(0.0), lambda n, c: n + c["share"] * (1 - F.exp(-F.col("key") * c["mean"])))
    d = d.withColumn("stretch", F.floor(before * stretches)).drop("weight", "classes")
    d = materialize(_summed(d).withColumn("whole", (F.col("sum") <= F.col("rest")) & (F.col("size") > 0)), "drawn")
    gaps = d.where("rest > 0").groupBy("source").agg((F.max("rest") - F.coalesce(F.sum(F.when(F.col("whole"), F.col("size"))), F.lit(0))).alias("gap"))
    at = F.struct("key", "doc_id", "row").alias("at")
    gaps = materialize(gaps.select(F.col("source").alias("s"), "gap", F.lit(None).cast(d.select(at).schema["at"].dataType).alias("last")), "gaps")
    left = d.where("not whole and size > 0 and rest > 0").select("source", "stretch", "key", "doc_id", "row", "size")
    # what the whole documents leave goes to those further on that still fit, until none does: a round takes one of each
    # such source at least. Gaps only shrink, so what doesn't fit once never does, and a round goes on where the last ended.
    fits = materialize(left.join(gaps, F.col("source").eqNullSafe(F.col("s"))).where("size <= gap").select(left.columns), "fits")
    taken = []
    while True:
        now = fits.join(gaps, F.col("source").eqNullSafe(F.col("s"))).drop("s").where((F.col("size") <= F.col("gap")) & (F.col("last").isNull() | (at > F.col("last"))))
        # the stretches from which nothing can fit are left out before the rows of the others are put in order
        new, found = materialize_counted(_summed(now, F.col("gap")).where("sum <= gap").select("source", "row", "size", at), "taken", n=F.count("*"))
        if not found["n"]:
            break
        taken.append(new)
        minus = new.groupBy("source").agg(F.sum("size").alias("minus"), F.max("at").alias("at"))
        gaps = gaps.join(minus, F.col("source").eqNullSafe(F.col("s")), "left")
        gaps = materialize(gaps.select("s", (F.col("gap") - F.coalesce("minus", F.lit(0))).alias("gap"), F.coalesce("at", "last").alias("last")), "gaps")
    # and the rest to the one left over that comes nearest to it, if any does
    off = F.abs(F.col("size") - F.col("gap"))
    if taken:
        gone = reduce(DataFrame.unionByName, taken).select(F.col("row").alias("gone"))
        left = left.join(gone, F.col("row") == F.col("gone"), "left_anti")
    left = left.join(gaps, F.col("source").eqNullSafe(F.col("s"))).where(off < F.col("gap"))
    last = left.groupBy("source").agg(F.min(F.struct(off.alias("off"), "key", "doc_id", "row")).alias("last")).select(F.col("last.row").alias("extra"))
    extra = reduce(DataFrame.unionByName, [t.select(F.col("row").alias("extra")) for t in taken], last)
    d = d.join(extra, F.col("row") == F.col("extra"), "left")
    drawn = F.col("whole") | F.col("extra").isNotNull()
    copies = (F.col("epochs") + F.when(drawn, 1).otherwise(0)).cast("int")
    return d.select(F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "k1", "k2")
