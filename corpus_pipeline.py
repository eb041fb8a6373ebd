"""A corpus pipeline: each stage takes the documents that the one before has kept.

Language identification drops what has no language, the Jaccard join leaves one document of each group of near
duplicates, decontamination drops documents with benchmark passages, the secret scan replaces secrets in the texts, and
packing gives the sequences to train on. Columns and rows that a stage doesn't decide about pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rosterank.llm import decontaminate, jaccard, langid, packing, secrets
from rosterank.llm.common import stage


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no text, no letter or no learned language."""
    return langid.keep_identified(docs, langid.train(docs))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of their 5-word shingles."""
    return jaccard.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold ten words in a row of the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With secrets replaced by their kind."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids, in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, packing.default_tokenizer(), keep_ids=True)


STAGES = [
    ("language", identified),
    ("near_duplicates", deduplicated),
    ("benchmark", decontaminated),
    ("secrets", redacted),
    ("packing", packed),
]

#: Language mixtures and tokenisation are not SQL; the pipeline is tested stage by stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
