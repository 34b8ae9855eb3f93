"""Names of micro-batches that no other streaming query shares."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def batch_token(spark: SparkSession, checkpoint: str, batch_id: int) -> str:
    """The batch's number with the id that the checkpoint gives its query.

    Batch numbers start at zero with every checkpoint; the id tells two feeds, or a feed
    read anew, apart, and stays the same when a query restarts from its checkpoint.
    """
    metadata = spark.read.text(f"{checkpoint.rstrip('/')}/metadata", wholetext=True).first()[0]
    return f"{json.loads(metadata)['id'].replace('-', '')}.{batch_id}"
