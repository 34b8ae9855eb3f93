"""Keyed upserts as DataFrame operators: target and changes in, new table content out.

Each one scans the target twice but shuffles it only if the changes are too large to be
broadcast: matching rows are found with a left join, new rows with a semi and an anti join
of the (small) change set, and AQE decides on measured sizes.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dailyfolio.functions.scores import SCORE, final_score
from dailyfolio.operators.ranking import dedup_last_by_id, keep_ranked


def _unmatched(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows without a match in target."""
    hit = target.select(*keys).join(source.select(*keys), list(keys), "left_semi")
    return source.join(hit, list(keys), "left_anti")


def update_matched(target: DataFrame, source: DataFrame, keys: Sequence[str],
                   provided: Sequence[str], keep_if_null: Sequence[str] = ()) -> DataFrame:
    """Set the provided columns on rows that exist. ``source`` is unique on ``keys``."""
    new = source.select(
        *keys, *[F.col(c).alias(f"_new_{c}") for c in provided], F.lit(True).alias("_hit"))
    joined = target.join(new, list(keys), "left")
    picked = []
    for c in target.columns:
        if c not in provided:
            picked.append(F.col(c))
        elif c in keep_if_null:
            picked.append(F.coalesce(f"_new_{c}", c).alias(c))
        else:
            picked.append(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
    return joined.select(*picked)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], provided: Sequence[str],
           defaults: dict[str, Column] | None = None,
           keep_if_null: Sequence[str] = ()) -> DataFrame:
    """Insert new keys with defaults; on a match change only the provided columns."""
    defaults = defaults or {}
    types = dict(target.dtypes)

    def inserted(c: str) -> Column:
        if c in keys:
            value = F.col(c)
        elif c in provided:
            value = F.coalesce(F.col(c), defaults[c]) if c in defaults and c in keep_if_null \
                else F.col(c)
        else:
            value = defaults.get(c, F.lit(None))
        return value.cast(types[c]).alias(c)

    kept = update_matched(target, source, keys, provided, keep_if_null)
    fresh = _unmatched(source, target, keys).select(*[inserted(c) for c in target.columns])
    return kept.unionByName(fresh)


PAPER_FIELDS = ("title", "abstract", "authors", "published_date", "source", "venue", "url",
                "pdf_url", "title_hash")


def upsert_papers(store: DataFrame, batch: DataFrame, fetched_at: dt.datetime) -> DataFrame:
    """Papers by id; the last batch row per id wins and ``fetched_at`` survives an update."""
    return upsert(store, dedup_last_by_id(batch), ["id"], PAPER_FIELDS,
                  {"fetched_at": F.lit(fetched_at)})


def upsert_scores(store: DataFrame, scored: DataFrame, scored_at: dt.datetime) -> DataFrame:
    """Scores by (paper, user).

    A null input leaves the stored value, ``scored_at`` is set on insert only, and the blend
    is computed from the merged columns.
    """
    given = ("llm_score", "pref_score", "llm_explanation")
    source = scored.select(
        "paper_id", "user_id", F.col("llm_score").cast(SCORE).alias("llm_score"),
        F.col("pref_score").cast(SCORE).alias("pref_score"), "llm_explanation")
    merged = upsert(store, source, ["paper_id", "user_id"], given,
                    {"scored_at": F.lit(scored_at)}, keep_if_null=given)
    return merged.withColumn(
        "final_score", final_score(F.col("llm_score"), F.col("pref_score")))


def new_log_rows(store: DataFrame, delivered: DataFrame, sent_at: dt.datetime) -> DataFrame:
    """Delivered pairs that the digest log does not hold yet, ready to append."""
    fresh = delivered.select("user_id", "paper_id").distinct()
    return (
        _unmatched(fresh, store, ["user_id", "paper_id"]).withColumn("sent_at", F.lit(sent_at))
    )


def log_sent(store: DataFrame, delivered: DataFrame, sent_at: dt.datetime) -> DataFrame:
    """The digest log with the delivered pairs; a repeat changes nothing."""
    return store.unionByName(new_log_rows(store, delivered, sent_at))


def update_users(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Set the given fields of existing chats; other chats are ignored."""
    fields = [c for c in changes.columns if c != "chat_id"]
    return update_matched(store, changes, ["chat_id"], fields)


RATING_KEYS = ["user_chat_id", "paper_id"]


def new_ratings(store: DataFrame, batch: DataFrame) -> DataFrame:
    """First rating per (chat, paper) that is not stored yet, ready to append."""
    first = keep_ranked(batch, RATING_KEYS, [F.col("id").asc()])
    return _unmatched(first, store, RATING_KEYS).select(*store.columns)


def insert_ratings(store: DataFrame, batch: DataFrame, keep: str = "first") -> DataFrame:
    """Ratings with the batch added, one per (chat, paper).

    ``first`` refuses a second rating; ``last`` lets it replace the earlier one.
    """
    if keep == "first":
        return store.unionByName(new_ratings(store, batch))
    last = keep_ranked(batch, RATING_KEYS, [F.col("id").desc()]).select(*store.columns)
    return store.join(last.select(*RATING_KEYS), RATING_KEYS, "left_anti").unionByName(last)
