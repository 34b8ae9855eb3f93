"""Which scored papers go into a digest, and the messages that carry them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dailyfolio.functions.bot import rating_actions
from dailyfolio.functions.messages import MILESTONE, digest_header, is_milestone, render_message
from dailyfolio.operators.papers import since
from dailyfolio.operators.ranking import top_n_by
from dailyfolio.operators.upserts import new_log_rows

POOL_FACTOR = 10


def recent_first() -> list:
    return [F.col("scored_at").desc(), F.col("final_score").desc(), F.col("paper_id").asc()]


def passes_final(scores: DataFrame, settings: DataFrame) -> DataFrame:
    """Scores that reach the user's minimum, with the user's digest size."""
    return (
        scores.join(settings.select("user_id", "min_rating", "max_papers"), "user_id")
        .where(F.col("final_score") >= F.col("min_rating")).drop("min_rating")
    )


def recent_pool(scores: DataFrame, factor: int = POOL_FACTOR) -> DataFrame:
    """Per user the latest ``factor * max_papers`` scores."""
    return top_n_by(scores, ["user_id"], recent_first(), F.col("max_papers") * factor,
                    salt=["paper_id"])


def unsent(scores: DataFrame, digest_log: DataFrame) -> DataFrame:
    keys = ["user_id", "paper_id"]
    return scores.join(digest_log.select(*keys), keys, "left_anti")


def scored_with_paper(scores: DataFrame, papers: DataFrame, as_of: dt.date | str,
                      days_back: int = 1) -> DataFrame:
    """Scores joined to their paper, if it is recent enough."""
    recent = since(papers, as_of, days_back).select(
        F.col("id").alias("paper_id"), "title", "abstract", "authors", "url", "pdf_url",
        "venue", "source", "published_date")
    return scores.join(recent, "paper_id")


def digest_pick(pool: DataFrame) -> DataFrame:
    """Per user the first ``max_papers`` of the pool, which is itself small per user."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*recent_first()))
    return pool.withColumn("_rn", place).where("_rn <= max_papers").drop("_rn")


def digest_order(picked: DataFrame) -> DataFrame:
    """Position by final score; ties stay in the order in which they were picked."""
    order = [F.col("final_score").desc(), F.col("scored_at").desc(), F.col("paper_id").asc()]
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    return picked.withColumn("position", place)


def unsent_digest(scores: DataFrame, digest_log: DataFrame, papers: DataFrame,
                  settings: DataFrame, as_of: dt.date | str, days_back: int = 1,
                  pool_before_anti: bool = True) -> DataFrame:
    """The digest of every user in ``settings``: recent scored papers that were not sent.

    Papers that were already sent take up places in the pool, as in the original pipeline;
    ``pool_before_anti=False`` removes them first.
    """
    passed = passes_final(scores, settings)
    if pool_before_anti:
        fresh = unsent(recent_pool(passed), digest_log)
    else:
        fresh = recent_pool(unsent(passed, digest_log))
    return digest_order(digest_pick(scored_with_paper(fresh, papers, as_of, days_back)))


def dry_run_digest(scored: DataFrame, papers: DataFrame, settings: DataFrame) -> DataFrame:
    """Digest straight from the passed candidates, without reading or writing the store."""
    sized = scored.join(settings.select("user_id", "max_papers"), "user_id")
    best = Window.partitionBy("user_id").orderBy(F.col("llm_score").desc(), F.col("rank").asc())
    top = sized.withColumn("position", F.row_number().over(best)).where("position <= max_papers")
    texts = papers.select(F.col("id").alias("paper_id"), "title", "abstract", "authors", "url",
                          "pdf_url", "venue", "source", "published_date")
    return top.join(texts, "paper_id").withColumn("final_score", F.col("llm_score"))


def rating_counts(ratings: DataFrame, users: DataFrame) -> DataFrame:
    """Ratings per user; 0 for users without any."""
    counted = ratings.groupBy(F.col("user_chat_id").alias("chat_id")).agg(
        F.count(F.lit(1)).alias("rating_count"))
    return users.select("user_id", "chat_id").join(counted, "chat_id", "left").withColumn(
        "rating_count", F.coalesce("rating_count", F.lit(0)))


def digest_messages(digest: DataFrame, counts: DataFrame, dry_run: bool = False) -> DataFrame:
    """Outbox rows (user_id, chat_id, position, kind, paper_id, text, actions).

    A header at position 0, one row per paper, and the milestone at the end for users who
    have just reached it. Users without papers get nothing.
    """
    known = counts.select(
        "user_id", "chat_id",
        (F.lit(0) if dry_run else F.col("rating_count")).cast("bigint").alias("rating_count"))
    sizes = digest.groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    users = known.join(sizes, "user_id")
    nothing = F.lit(None).cast("array<struct<label:string,data:string>>")
    no_paper = F.lit(None).cast("string")
    header = users.select(
        "user_id", "chat_id", F.lit(0).alias("position"), F.lit("header").alias("kind"),
        no_paper.alias("paper_id"), digest_header(F.col("rating_count")).alias("text"),
        nothing.alias("actions"))
    body = digest.join(known, "user_id").select(
        "user_id", "chat_id", F.col("position").cast("int").alias("position"),
        F.lit("paper").alias("kind"), "paper_id",
        render_message(F.col("title"), F.col("url"), F.col("authors"), F.col("source"),
                       F.col("venue"), F.col("llm_explanation"), F.col("final_score"))
        .alias("text"),
        rating_actions(F.col("paper_id")).alias("actions"))
    tail = users.where(is_milestone(F.col("rating_count"))).select(
        "user_id", "chat_id", (F.col("_n") + 1).alias("position"),
        F.lit("milestone").alias("kind"), no_paper.alias("paper_id"),
        F.lit(MILESTONE).alias("text"), nothing.alias("actions"))
    return header.unionByName(body).unionByName(tail)


def delivered_to_log(outbox: DataFrame, receipts: DataFrame, digest_log: DataFrame,
                     sent_at: dt.datetime) -> DataFrame:
    """Log rows for the papers whose message was delivered.

    ``receipts`` has (user_id, position, delivered).
    """
    ok = receipts.where(F.col("delivered")).select("user_id", "position")
    sent = outbox.where(F.col("kind") == "paper").join(ok, ["user_id", "position"])
    return new_log_rows(digest_log, sent, sent_at)
