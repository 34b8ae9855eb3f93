"""Rating callbacks into the ratings table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dailyfolio.functions.bot import parse_rating_callback
from dailyfolio.operators.papers import valid_refs
from dailyfolio.operators.upserts import new_ratings
from dailyfolio.session import written
from dailyfolio.sources.log import Snapshot
from dailyfolio.sources.tables import TableStore, Write, bucket
from dailyfolio.sources.updates import rating_updates
from dailyfolio.streaming.tokens import batch_token


def parsed_ratings(callbacks: DataFrame) -> DataFrame:
    """Callbacks with paper, score and, for refused ones, the reason."""
    return callbacks.withColumn("_r", parse_rating_callback(F.col("data"))).select(
        "update_id", "ts", "user_chat_id", "_r.*")


def accepted_ratings(parsed: DataFrame, papers: DataFrame) -> DataFrame:
    """Valid ratings of known papers, in the layout of the ratings table."""
    rows = parsed.where(F.col("reason").isNull()).select(
        F.col("update_id").alias("id"), "user_chat_id", "paper_id",
        F.col("score").cast("smallint").alias("score"), F.col("ts").alias("created_at"))
    return valid_refs(rows, papers=papers)


def refused_ratings(parsed: DataFrame, papers: DataFrame) -> DataFrame:
    """Everything else, with a reason."""
    unknown = valid_refs(parsed.where(F.col("reason").isNull()), papers=papers, rejected=True) \
        .withColumn("reason", F.lit("Unknown paper"))
    bad = parsed.where(F.col("reason").isNotNull())
    return bad.unionByName(unknown).select("update_id", "user_chat_id", "paper_id", "reason")


def repeated_ratings(accepted: DataFrame, added: DataFrame) -> DataFrame:
    """Accepted ratings that were not added, since the chat has rated the paper before."""
    return accepted.join(added.select("id"), "id", "left_anti").select(
        F.col("id").alias("update_id"), "user_chat_id", "paper_id", F.lit("Already rated").alias("reason"))


def rating_stream(updates: DataFrame, store: TableStore, checkpoint: str,
                  available_now: bool = True) -> StreamingQuery:
    """Append each batch's new ratings; refused ones go to ``rejected_ratings``.

    Only the batch's rows are written, both tables in one commit, and only the buckets of the batch's chats are read for
    earlier ratings. A replayed batch finds its token, which names the query of the checkpoint, and is skipped. A second
    rating is refused as ``Already rated``, also one that another feed stores meanwhile.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        parsed = parsed_ratings(batch).persist()
        buckets = [r[0] for r in parsed.select(bucket(F.col("user_chat_id"))).distinct().collect()]  # at most BUCKETS

        def make(at: Snapshot) -> list[Write]:
            # The papers this batch mentions: a small set, found without shuffling the store.
            papers = store.load("papers", at=at).select("id").join(
                parsed.select(F.col("paper_id").alias("id")), "id", "left_semi")
            accepted = accepted_ratings(parsed, papers)
            added = written(new_ratings(store.load("ratings", buckets, at), accepted), "new-ratings")
            refused = refused_ratings(parsed, papers).unionByName(repeated_ratings(accepted, added))
            return [Write("rejected_ratings", "add", refused), Write("ratings", "add", added)]

        store.update(["ratings"], make, f"ratings:{batch_token(store.spark, checkpoint, batch_id)}")
        parsed.unpersist()

    writer = rating_updates(updates).writeStream.foreachBatch(apply).option(
        "checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def rating_counts_stream(ratings: DataFrame) -> DataFrame:
    """Running number of ratings per chat; ``keep_rating_counts`` writes it in update mode."""
    return ratings.groupBy("user_chat_id").agg(F.count(F.lit(1)).alias("rating_count"))


def keep_rating_counts(ratings: DataFrame, store: TableStore, checkpoint: str,
                       available_now: bool = True) -> StreamingQuery:
    """The running counts in the table ``rating_counts``: each batch merges the chats whose count has changed."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        store.merge("rating_counts", batch, batch_token(store.spark, checkpoint, batch_id))

    writer = rating_counts_stream(ratings).writeStream.outputMode("update").foreachBatch(apply).option(
        "checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
