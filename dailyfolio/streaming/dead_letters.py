"""What the update feed holds besides ratings and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from dailyfolio.sources.tables import TableStore
from dailyfolio.sources.updates import dead_letters
from dailyfolio.streaming.tokens import batch_token


def dead_letter_stream(updates: DataFrame, store: TableStore, checkpoint: str,
                       available_now: bool = True) -> StreamingQuery:
    """Append unreadable lines and unknown updates to ``dead_letters``, with file and reason, once under replay."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        store.append("dead_letters", batch, batch_token(store.spark, checkpoint, batch_id))

    writer = dead_letters(updates).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
