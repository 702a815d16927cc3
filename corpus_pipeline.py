"""The corpus pipeline: quality classifier, near-dedup, personal data, mixing, tokens. Each stage takes what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brookwell.llm import bpe, gam, minhash, mixing, pii
from brookwell.llm.common import delete_dir, fresh_dir, scratch

#: Documents that score less are rejected; the same cut as op8's predicted.
LEAST_SCORE = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels of this stage's input.

    Each row is scored for itself by its whole text, be it null, empty or repeated; without labels (or with labels of
    one kind alone) all have that rate as their score. An empty table stays empty; columns beside are kept as they are.
    """
    model = gam.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = gam.scored(docs, model, keep_columns=True)
    return found.where(F.col(found.columns[-1]) >= LEAST_SCORE).select(*docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """k1, k2 and row, a struct of all of the table's columns: no name of theirs can meet one of the stage's own."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(*(k.alias(n) for k, n in zip(mixing.row_keys("doc_id", "text"), ("k1", "k2"), strict=True)), row)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id (null is the greatest; of several texts
    with that id, one by its hashes), once if it is repeated. Texts without words (null, blank) are groups by id and
    text. An empty table stays empty; columns beside are kept as they are."""
    rows = minhash.near_duplicates(docs, rows=True).select("class", F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "k1", "k2").alias("row"))
    best = rows.where("class is not null").groupBy("class").agg(F.min("row").alias("row")).select("row")
    kept = best.unionByName(rows.where("class is null").select("row")).select("row.k1", "row.k2")
    found = _keyed(docs).join(kept, ["k1", "k2"], "left_semi")
    # the window's key is the join's, so rows aren't dealt anew
    first = Window.partitionBy("k1", "k2").orderBy(F.lit(0))
    return found.withColumn("at", F.row_number().over(first)).where("at = 1").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data taken by [KIND]; n_chars follows the new text. Null texts stay null, with null
    n_chars; repeated rows stay, an empty table stays empty, other columns are kept as they are."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix holds it; copies of rows that are repeated are dealt evenly among them.

    Null and blank texts have no words and don't come; null sources are one source. An empty table stays empty;
    columns beside are kept as they are.
    """
    copies = mixing.mix(docs).groupBy("k1", "k2").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    out = _keyed(docs).join(copies, ["k1", "k2"])
    at = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(0)))
    out = out.withColumn("at", at).withColumn("own", F.floor((F.col("copies") - F.col("at") + F.col("rows")) / F.col("rows")).cast("int"))
    return out.where("own > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("own")))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, decoded again: ids that don't give the document's text back break the stage. A null or
    empty text has no ids; repeated rows and null ids stay, an empty table stays empty, other columns are left out."""
    coded = bpe.encode_documents(docs, output="round_trip")
    lost = F.raise_error(F.concat(F.lit("the ids of a document don't decode to its text: doc_id "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return coded.select("doc_id", F.when(F.col("text_sha256") == F.col("decoded_sha256"), F.col("ids")).otherwise(lost.cast("array<int>")).alias("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mixing", mixed),
    ("tokens", tokens),
]

#: The classifier and the near-duplicate groups have no SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents; each one's rows go to the shared folder as Parquet and are read again. What a
    stage wrote on its way, and its predecessor's rows, are deleted once its own are written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_dir(spark, f"stage-{name}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last:
            delete_dir(spark, last)
        last = path
    return docs
