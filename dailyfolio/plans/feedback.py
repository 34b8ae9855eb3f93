"""Ratings, settings and dead letters from one update feed."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery

from dailyfolio.sources.tables import TableStore
from dailyfolio.sources.updates import read_updates
from dailyfolio.streaming.dead_letters import dead_letter_stream
from dailyfolio.streaming.ratings import rating_stream
from dailyfolio.streaming.settings import settings_stream


def feedback_stream(store: TableStore, path: str, checkpoint: str,
                    available_now: bool = True) -> list[StreamingQuery]:
    """Start all consumers; each keeps its own checkpoint."""
    return [
        rating_stream(read_updates(store.spark, path), store, f"{checkpoint}/ratings",
                      available_now),
        settings_stream(read_updates(store.spark, path), store, f"{checkpoint}/settings",
                        available_now),
        dead_letter_stream(read_updates(store.spark, path), store, f"{checkpoint}/dead-letters",
                           available_now),
    ]
