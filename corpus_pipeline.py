"""The training-data pipeline: documents through four stages, each written as Parquet and read again.

1. quality: documents that the quality classifier rejects go.
2. near_duplicates: one row of each SimHash component stays, that with the smallest id; null ids come last, and of rows with
   one id that with the smallest digest of its text stays, and of rows that are equal in both, one (with an empty text rather
   than none). Ids name no rows here: those that share one, or have none, stay each for its own component.
3. decontamination: documents that benchmark passages contaminate go; all others stay whole.
4. tokens: each document's SentencePiece ids, with their digest and the checks of the round trip.

The first three return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weatherglass.llm import common, decontamination, quality, sentencepiece_codec, simhash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # A row is known by its id and its text's digest: each component's least row is found without the texts. Rows that are equal
    # in both become one before and in the exchange of the texts, so that no key brings many of them into a task; the join with
    # the least rows keeps that exchange's partitioning and order.
    names = common.fresh(docs, "no_id", "id", "digest", "no_text")
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    values = (doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), F.sha2(F.coalesce(text, F.lit("")), 256), text.isNull())
    key = [x.alias(n) for x, n in zip(values, names, strict=True)]
    rows = common.cut(simhash.fingerprints(docs.select("doc_id", "text"), *key))
    first = simhash.rooted(rows, F.min(F.struct(*names))).groupBy("root").agg(F.min("least").alias("least")).select("least.*")
    one = docs.select("*", *key).dropDuplicates(names)
    return one.join(first, list(names), "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.kept(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(docs, f"{sentencepiece_codec.TOKENIZERS}/piece_bpe_32k.model", ids=True)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: Trained weights and XXH64 fingerprints can't be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
