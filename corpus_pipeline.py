"""The corpus pipeline: quality, near duplicates, benchmark passages, source weights, token files.

Each stage takes the documents that the one before kept and returns documents with the same columns; the last returns the
documents as they stand in the token files. Stages are written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.llm import decontaminate, mixing, quality, shingle_join, texts, tokens
from crossweave.session import scratch_dir, stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of the documents at hand. Null ids are kept: they have no decision."""
    made = quality.score(docs, quality.learn(docs, _table(spark, sf_dir, "labels")))
    with texts.small_batches(spark):
        low = stage(made.filter(F.col("score") < quality.ACCEPT).select(F.col("doc_id").alias("_low")).distinct(), "low-quality")
    return docs.join(low, F.col("doc_id") == F.col("_low"), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return shingle_join.distinct_documents(docs, shingle_join.Rule(5, 8, 10))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate takes them."""
    return mixing.emit(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the mix's documents, from the token files."""
    return tokens.tokens(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: A trained classifier decides in the first stage, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    folder = f"{scratch_dir(spark)}/crossweave/pipeline-{uuid.uuid4().hex}"
    for i, (_, step) in enumerate(STAGES):
        made = step(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{i}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{i}")
    return docs
