"""Documents to packed training sequences, one operator a stage.

Each stage gets all that its predecessor kept, written as Parquet and read
again: toxic documents go, repeated lines go, one document of each group of
near copies stays, documents with benchmark passages go, the rest is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kindred.llm import stages
from kindred.llm.arrowtext import clear_driver, small_batches, small_scans
from kindred.storage import materialise

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


BATCH_BYTES = 2 << 20


def bounded(spark: SparkSession) -> None:
    """Smaller batches than a single operator's: driver and executors serve all stages, one after another."""
    small_batches(spark, size=BATCH_BYTES)
    small_scans(spark)
    clear_driver(spark)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return stages.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return stages.drop_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return stages.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return stages.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return stages.pack(docs, TOKENIZER)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: No stage but line deduplication can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
