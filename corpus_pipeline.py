"""The training-data pipeline: documents in, packed sequences out, one Parquet table per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dailyfolio.llm import decontam, langid, neardup, packing, pii
from dailyfolio.llm.words import table
from dailyfolio.session import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: too far from every centroid, or without a letter (null and empty texts too).

    A null lang is only left out of the fit. Each row is judged by its own text, so repeated rows stay or go together.
    """
    return langid.keep_identified(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id; links are five-word shingles of similarity 0.8.

    Null, empty and wordless texts are one group; a row without an id stays only where its group has none; rows that
    repeat id and text count once.
    """
    return neardup.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts, and rows without an id, hold none and stay."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts, in every row alike; null and empty texts stay as they are."""
    return pii.mask(docs, pii.fit(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences; a null or empty text is one token."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: The classifiers cannot be stated in SQL; the operators' own tests and tests/llm/test_pipeline.py check the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's table is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
