"""Chat commands into the users table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from dailyfolio.operators.settings import apply_settings, settings_changes
from dailyfolio.session import written
from dailyfolio.sources.log import Snapshot
from dailyfolio.sources.tables import TableStore, Write
from dailyfolio.sources.updates import message_updates
from dailyfolio.streaming.tokens import batch_token


def settings_stream(updates: DataFrame, store: TableStore, checkpoint: str,
                    available_now: bool = True) -> StreamingQuery:
    """Fold each batch of messages into the users table, of which only the changed rows are written.

    The table itself is the keyed state: what is pending for a chat is one of its columns, so
    the schedule, which other jobs also write, never lives in two places. If such a job comes between, the
    batch is folded again over what it has left.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        def make(at: Snapshot) -> list[Write]:
            users = store.load("users", at=at)
            theirs = written(users.join(batch.select("chat_id").distinct(), "chat_id", "left_semi"), "chats")
            changes = written(settings_changes(batch, theirs), "changes")
            touched = theirs.join(changes.select("chat_id"), "chat_id", "left_semi")
            return [Write("users", "delta", apply_settings(touched, changes, users))]

        batch.persist()
        store.update(["users"], make, f"users:{batch_token(store.spark, checkpoint, batch_id)}")
        batch.unpersist()

    writer = message_updates(updates).writeStream.foreachBatch(apply).option(
        "checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
