"""From raw documents to packed training sequences, in five stages.

language     documents without a language, and those that mix languages or fit none, go (ppm)
exact        of equal texts the one that the content sort keeps stays
near         one document of each group of near-duplicates stays, the smallest doc_id
secrets      secrets are replaced by a mark; no document goes
packing      the texts that stay become pieces of sequences of 4096 tokens

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, with the columns
of documents but for the last one. ``run`` writes each stage's result as Parquet to
the shared folder and reads it again as the next one's docs.

SQL cannot express the language model, the tokenizer or the packing; the rows are
tested against brute-force versions in tests/llm/test_pipeline.py.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import bpe, content_sort, ngram_join, packing, ppm, secrets
from treeloom.llm.common import checkpoint_dir, checkpointed, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ppm.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return content_sort.distinct(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go by their doc_id; those without one, or with one that repeats, go by their text too, and of
    several first ones of a group the one with the least md5 stays."""
    rows = checkpointed(ngram_join.linked(docs, classes=True))
    often = checkpointed(rows.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    gone = rows.filter("doc_id <> component_id").select("doc_id").distinct().join(often, "doc_id", "left_anti")
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    if often.isEmpty() and docs.filter("doc_id IS NULL").isEmpty():
        return left

    odd = docs.filter("doc_id IS NULL").unionByName(docs.join(often, "doc_id", "left_semi").select(docs.columns))
    odd = ngram_join.classes_of(odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).filter("class IS NOT NULL").select("doc_id", "class", F.md5("text").alias("mark"))
    odd = checkpointed(odd.join(rows.filter("class IS NOT NULL").select("class", "component", "component_id").distinct(), "class"))
    first = odd.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("mark").alias("first"))
    lost = odd.join(first, "component", "left").filter(~F.col("doc_id").eqNullSafe(F.col("component_id")) | (F.col("mark") != F.col("first")))
    lost = lost.select(F.col("doc_id").alias("lost_id"), F.col("mark").alias("lost_mark")).distinct()
    same = (F.md5(F.coalesce("text", F.lit(""))) == F.col("lost_mark")) & F.col("doc_id").eqNullSafe(F.col("lost_id"))
    return left.join(lost, same, "left_anti")


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, bpe.default_path()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("secrets", secret), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
