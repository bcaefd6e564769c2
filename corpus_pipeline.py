"""A corpus pipeline of five stages, each one of the operators of gaugeline.llm.

Every stage takes what the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeline.llm import minhash, mixing, packing, private, quality
from gaugeline.llm.common import finished, release, small_batches
from gaugeline.llm.queries import tokenizer_file


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not reject as poor."""
    small_batches(spark)
    return quality.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    small_batches(spark)
    return minhash.kept_documents(docs)


def private_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return private.redacted_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in fixed windows."""
    small_batches(spark)
    # workers serve all stages, so the table of pieces that they keep is a small one
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), most_pieces=200_000)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("personal data", private_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Tokenizer ids and a fitted model are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what the last one returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        after = finished(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{k + 1}")
        if k:
            release(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
