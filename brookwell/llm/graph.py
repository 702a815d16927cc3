"""Connected components as DataFrame operations: alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize_counted, spread_join


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for each vertex of the edges (a, b: long); root is the smallest vertex of the component.

    Each round halves the depth of the trees at least, so rounds grow with the logarithm of a component's diameter.
    Nothing but two numbers a round comes to the driver; the links of a vertex with very many are spread over tasks.
    """

    def stars(e: DataFrame, n: int, larger: bool) -> DataFrame:
        both = e.union(e.select("b", "a")) if larger else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", "n", F.struct(F.least("a", "m").alias("m")).alias("value"))
        joined = spread_join(both, least, ["a"], 2 * n if larger else n, "b").select("a", "b", F.col("value.m").alias("m"))
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not larger:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("value.m").alias("b")))
        return out.where("a <> b").distinct()

    def written(e: DataFrame, label: str) -> tuple[DataFrame, dict]:
        return materialize_counted(e, label, n=F.count("*"), mark=F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")))

    e, now = written(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while now["n"] and now != last:
        last = now
        # a large star makes one edge of each at most, so the count before it bounds the small star's
        e, now = written(stars(stars(e, now["n"], True), now["n"], False), "stars")
    return e.select(F.col("a").alias("v"), F.col("b").alias("root")).union(e.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
