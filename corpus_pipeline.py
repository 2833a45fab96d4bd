"""Training-data pipeline over ``documents``: language ID, line dedup, near copies,
mixing, packing.  Each stage takes what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardlens.llm import jaccard_join, language_id, line_dedup, mixing, packing
from wardlens.llm.common import store, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go."""
    return language_id.keep_known(docs)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for the first of each."""
    return line_dedup.without_recurring(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay by their rate; none is repeated.  The target is 1.3 times what the
    clean domain has, so clean documents reach the rate of 1 and stay."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"), repeat=1.3, most=1.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, by sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_recurring_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Clustered centroids, a fitted classifier and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
