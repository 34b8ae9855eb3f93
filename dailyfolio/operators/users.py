"""Which users are due, with which settings, and when they are due next."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dailyfolio.session import as_date

# Settings of a user who has chosen none.
DEFAULTS = {"max_papers": 10, "min_rating": 6.0, "digest_frequency": 1}


def active_users(users: DataFrame) -> DataFrame:
    return users.where(F.col("active"))


def user_by_chat(users: DataFrame, chat_id: int) -> DataFrame:
    return users.where(F.col("chat_id") == chat_id)


def due_users(users: DataFrame, as_of: dt.date | str) -> DataFrame:
    day = F.col("next_digest_date")
    return users.where(day.isNull() | (day <= F.lit(as_date(as_of))))


def has_profile(users: DataFrame) -> DataFrame:
    return users.where(F.coalesce("keyword_profile", F.lit("")) != "")


def _nonzero(column: str, default: int) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit(0)), F.lit(default)).cast("int")


def resolve_settings(users: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Fill unset settings. For the counts 0 means unset; a minimum rating of 0 is kept."""
    d = {**DEFAULTS, **(defaults or {})}
    return users.withColumns({
        "max_papers": _nonzero("max_papers", d["max_papers"]),
        "digest_frequency": _nonzero("digest_frequency", d["digest_frequency"]),
        "min_rating": F.coalesce("min_rating", F.lit(d["min_rating"]).cast("decimal(3,1)")),
        "keyword_profile": F.coalesce("keyword_profile", F.lit("")),
    })


def advance_schedule(due: DataFrame, as_of: dt.date | str) -> DataFrame:
    """chat_id and next digest date of every due user, sent to or not."""
    return due.select(
        "chat_id",
        F.date_add(F.lit(as_date(as_of)), _nonzero("digest_frequency", 1))
        .alias("next_digest_date"),
    )
