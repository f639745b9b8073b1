"""The corpus pipeline: quality, near-duplicates, secrets, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of docs; each works on all rows that the one before has kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import mixing, neardup, pieces, quality, secrets
from corvane.llm.shared import saved, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fit on the labels of sf_dir, doesn't reject."""
    model = quality.fitted(docs, table(spark, sf_dir, "labels"))
    return quality.kept(docs, model)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, a likeness of 0.8."""
    return neardup.representatives(docs)


def safe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark."""
    return secrets.redacted(docs)


def blended(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source as often as its target asks for."""
    return mixing.sampled(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    return pieces.encoded(docs, keep=("doc_id", "source", "lang"))


STAGES = [("quality", good), ("near_duplicates", single), ("secrets", safe), ("mixture", blended), ("pieces", tokens)]

#: SQL cannot fit the classifier; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
