"""A training corpus from raw documents, in stages that each call one operator.

Defined cases: documents of null or empty text, or without an item, are rejected by the first stage, so they are in no
result; null ids, languages and sources stay. Repeated rows and rows of one id are one document to near_dedup, which
keeps one of them. Ties go to the least id. Texts of any length are read whole. Empty tables give an empty result. Other
columns than those of documents pass through all stages but the last; n_chars follows the text where it is cut, and is
asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, neardup, quality, tokenids
from tessera.llm._stage import staged


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained scorer keeps."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages; those that are little else go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n_chars="n_chars")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, in equal parts by source."""
    return mixing.mix(docs, n_chars="n_chars")


def token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of each document drawn."""
    return tokenids.token_blocks(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_blocks", token_blocks),
]

#: Sequential posterior pruning, a trained scorer and byte-pair encoding are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of token_blocks() after all stages; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
