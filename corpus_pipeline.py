"""The corpus job: stages over ``documents``, each written as Parquet and read by the next.

Every stage but the last returns rows of its input with all their columns. Each judges what the
stage before it kept; what it rejects is gone for the rest of the job.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import (
    decontaminate, exact_dedup, jaccard_join, language_id, packing, queries as llm_queries)
from plumbline.storage import checkpoint_dir

#: Near duplicates in the job: word shingles of five, a similarity of 0.8.
NEAR_SHINGLE = 5
NEAR_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language the model is sure of, go."""
    return language_id.keep_identified(docs, language_id.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the largest identifier."""
    return exact_dedup.keep_owners(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays, the smallest identifier."""
    return jaccard_join.keep_representatives(docs, shingle=NEAR_SHINGLE, percent=NEAR_PERCENT)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of ``benchmark`` go."""
    return decontaminate.remove_contaminated(
        docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of what is left."""
    return packing.pack_documents(docs, llm_queries.tokenizer_path(packing.TOKENIZER))


STAGES = [("language", language), ("exact dedup", exact), ("near duplicates", near),
          ("benchmark decontamination", leaks), ("packing", pack)]

#: Language labels and token ids have no SQL form; tests/llm/test_corpus_pipeline.py checks the job.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return result
        result.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
