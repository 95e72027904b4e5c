"""A training corpus in four stages: reject toxic documents, keep one of each near-duplicate group, mix sources, encode.

Every stage works on all rows that the one before kept; run() writes each result to the shared folder as Parquet
and reads it again. Nulls, empty and very long texts, repeated rows and empty tables are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from exprlake.llm import jaccard, mix, queries, toxic
from exprlake.llm.common import stage, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is predicted clean, by a model fitted on the labelled rows of docs."""
    return toxic.keep_clean(docs, table(spark, sf_dir, "labels"))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of 5-word shingles, Jaccard 0.8 or more; the smallest doc_id stays."""
    return jaccard.keep_one(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight: a document that is taken twice is there twice."""
    return mix.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text."""
    return queries.bpe_digests(docs)


STAGES = [("toxicity", reject_toxic), ("ngram_jaccard", one_per_group), ("mix", mix_sources), ("bpe", encode)]
#: SQL can express neither the fitted classifier nor the splitting tree; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
