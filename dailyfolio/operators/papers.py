"""Paper batches against the stored papers, and reference checks."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dailyfolio.session import as_date


def since(df: DataFrame, as_of: dt.date | str, days_back: int = 1,
          column: str = "published_date") -> DataFrame:
    """Rows dated on or after ``as_of - days_back``; a literal bound, so it reaches the scan."""
    return df.where(F.col(column) >= F.lit(as_date(as_of) - dt.timedelta(days=days_back)))


def require_fields(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows in which any of the columns is null or blank."""
    present = [F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in cols]
    return df.where(reduce(Column.__and__, present))


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def new_papers(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Batch rows whose title hash is not stored yet.

    The store is first cut down to hashes of the batch, which AQE can do by broadcasting the
    batch's hashes, so a large store is scanned on one column and never shuffled.
    """
    known = stored.select("title_hash").join(
        batch.select("title_hash"), "title_hash", "left_semi")
    return batch.join(known, "title_hash", "left_anti")


def canonical_ids(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Batch with the stored id of papers that are already stored under the same title."""
    known = (
        stored.select("title_hash", F.col("id").alias("stored_id"))
        .join(batch.select("title_hash"), "title_hash", "left_semi")
    )
    return (
        batch.join(known, "title_hash", "left")
        .withColumn("id", F.coalesce("stored_id", "id")).drop("stored_id")
    )


def valid_refs(df: DataFrame, papers: DataFrame | None = None, users: DataFrame | None = None,
               paper_col: str = "paper_id", user_col: str = "user_id",
               rejected: bool = False) -> DataFrame:
    """Rows whose paper and user exist; with ``rejected`` the rows that fail a check."""
    checks = []
    if papers is not None:
        checks.append((paper_col, papers.select(F.col("id").alias(paper_col))))
    if users is not None:
        checks.append((user_col, users.select(F.col("id").alias(user_col))))
    if not rejected:
        for column, known in checks:
            df = df.join(known, column, "left_semi")
        return df
    for column, known in checks:
        df = df.join(known.withColumn(f"_has_{column}", F.lit(True)), column, "left")
    failed = [F.col(f"_has_{column}").isNull() for column, _ in checks]
    return df.where(reduce(Column.__or__, failed)).drop(*[f"_has_{c}" for c, _ in checks])


def with_user_id(ratings: DataFrame, users: DataFrame) -> DataFrame:
    """Ratings are keyed by chat; add the user's id."""
    ids = users.select(F.col("id").alias("user_id"), F.col("chat_id").alias("user_chat_id"))
    return ratings.join(ids, "user_chat_id")


def ratings_with_text(ratings: DataFrame, papers: DataFrame) -> DataFrame:
    """Each rating with title and abstract, empty when the paper is unknown."""
    texts = papers.select(F.col("id").alias("paper_id"), "title", "abstract")
    return ratings.join(texts, "paper_id", "left").fillna("", ["title", "abstract"])
