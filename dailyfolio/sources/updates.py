"""The bot's update feed, as a stream or as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dailyfolio.schemas import UPDATE


def read_updates(spark: SparkSession, path: str, stream: bool = True,
                 max_files: int = 100) -> DataFrame:
    """One JSON update per line, with ``kind``: rating, message, ignored or bad json.

    A callback takes precedence over a message. ``file`` is where the line stands; ``_corrupt_record`` holds what could not be read.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", max_files) if stream else spark.read
    raw = reader.schema(UPDATE + ", _corrupt_record string").json(path)
    kind = (
        F.when(F.col("_corrupt_record").isNotNull(), F.lit("bad json"))
        .when(F.col("callback_query").isNotNull(), F.lit("rating"))
        .when(F.col("message").isNotNull(), F.lit("message"))
        .otherwise(F.lit("ignored"))
    )
    return raw.select("*", F.col("_metadata.file_path").alias("file")).withColumn("kind", kind)


def rating_updates(updates: DataFrame) -> DataFrame:
    """(update_id, ts, user_chat_id, data) of the callbacks; the sender rates."""
    return updates.where(F.col("kind") == "rating").select(
        "update_id", "ts", F.col("callback_query.from.id").alias("user_chat_id"),
        F.col("callback_query.data").alias("data"))


def message_updates(updates: DataFrame) -> DataFrame:
    """(update_id, ts, chat_id, text) of the messages; the chat is configured."""
    return updates.where(F.col("kind") == "message").select(
        "update_id", "ts", F.col("message.chat.id").alias("chat_id"),
        F.col("message.text").alias("text"))


def dead_letters(updates: DataFrame) -> DataFrame:
    """(update_id, reason, line, file) of what no job consumes: unreadable lines, and updates of no known kind.

    A line that could be read is given by the fields that it has.
    """
    known = F.to_json(F.struct("update_id", "ts"))
    return updates.where(F.col("kind").isin("bad json", "ignored")).select(
        "update_id", F.col("kind").alias("reason"), F.coalesce("_corrupt_record", known).alias("line"), "file")
