"""The registered queries of the corpus operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, gam, minhash, mixing, oracles, pii, rules, sst, suffix, topk, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(_read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    scores = F.array_join(F.transform("spans", lambda s: F.round(s["score"], 2).cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(pii.span_list(base).cast("binary"), 256).alias("base_sha256"), pii.span_list(F.col("spans")).alias("spans"), scores.alias("scores"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_read(spark, sf_dir, "documents"), output="digests")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), 20, F.col("vec_id") % 20 == 0)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_sst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sst.read_shards(sst.write_shards(_read(spark, sf_dir, "documents")))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = gam.scored(docs, gam.fit(docs, _read(spark, sf_dir, "labels")))
    return out.select("doc_id", gam.in_holdout(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.repeated_spans(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_read(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_bpe, op3_minhash, op4_topk, op5_mixing, op6_sst, op7_rules, op8_gam, op9_suffix, op10_warc)}


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express on whole tables; the others have brute-force tests in tests/llm."""
    return {"op3_minhash": oracles.OP3, "op4_topk": oracles.OP4, "op9_suffix": oracles.OP9, "op10_warc": oracles.OP10}
