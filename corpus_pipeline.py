"""The corpus pipeline: filter, deduplicate and encode documents. Each stage is one operator on all that the one before
kept; what it returns is written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragtide.llm import decontaminate, line_dedup, minhash_dedup, quality, sentencepiece
from ragtide.llm._store import Store


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that come elsewhere first, equal or within two edits; documents left without text go."""
    return line_dedup.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, a similarity of 0.8)."""
    return minhash_dedup.drop_near_duplicates(docs, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each document: its numbers of ids, digests of ids and of the text decoded from them, and the ids themselves."""
    return sentencepiece.report(docs, with_ids=True)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_documents),
    ("decontamination", drop_benchmark),
    ("sentencepiece", encode),
]

#: SQL can express neither the classifier nor the encoder; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = store.put(stage(spark, docs, sf_dir), f"{k}_{name}")
        if k:
            store.drop(f"{k - 1}_{STAGES[k - 1][0]}")
        store.free()
    return docs
