"""First/last/top-n per key, built so that one hot key never lands whole in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dailyfolio.functions.text import title_hash

# row_number() <= n is pruned before the shuffle only up to this many rows per key
# (spark.sql.optimizer.windowGroupLimitThreshold).
PRUNED_BEFORE_SHUFFLE = 1000
# Slices of a key that are ranked on their own first; fewer when each may keep many rows.
SALTS, SALTS_LARGE = 32, 8
CHUNK_ROWS = 1_000_000


def keep_ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1,
                rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key; their position is kept as ``rank`` if named."""
    if n > PRUNED_BEFORE_SHUFFLE:
        return top_n_by(df, keys, order, F.lit(n), rank, salts=SALTS_LARGE)
    name = rank or "_rn"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = out.where(F.col(name) <= n)
    return out if rank else out.drop(name)


def top_n_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: Column,
             rank: str | None = None, salt: Sequence[str] | None = None,
             salts: int = SALTS) -> DataFrame:
    """As ``keep_ranked`` with a limit taken from each row.

    Ranks first inside salted slices of a key, then over the survivors: at most
    ``salts * limit`` rows of a key meet in one task, and the result is exact.
    """
    name = rank or "_rn"
    by = [F.col(c) for c in (salt or [c for c in df.columns if c not in keys])]
    out = (
        df.withColumn("_limit", limit)
        .withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)))
        .withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)))
        .where("_rn <= _limit").drop("_rn", "_salt")
        .withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .where(F.col(name) <= F.col("_limit")).drop("_limit")
    )
    return out if rank else out.drop(name)


def numbered(df: DataFrame, keys: Sequence[str], by: str, name: str,
             chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Position (from 1) of each row within its key, ordered by a unique integer column.

    Rows are numbered inside ranges of ``by`` that hold at most ``chunk_rows`` rows, then
    shifted by the sizes of the earlier ranges, so no window ever spans a whole hot key.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(by) / chunk_rows))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    )
    within = Window.partitionBy(*keys, "_chunk").orderBy(by)
    return (
        chunked.withColumn("_rn", F.row_number().over(within))
        .join(offsets, [*keys, "_chunk"])
        .withColumn(name, (F.col("_rn") + F.col("_offset")).cast("bigint"))
        .drop("_rn", "_offset", "_chunk")
    )


def last_before(df: DataFrame, keys: Sequence[str], by: str, value: Column, name: str,
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Latest non-null ``value`` strictly before each row of its key, ordered by ``by``.

    ``by`` is a unique integer. Works range by range like ``numbered``: the value carried
    into a range is the last one of the ranges before it.
    """
    chunked = df.withColumn("_value", value).withColumn("_chunk", F.floor(F.col(by) / chunk_rows))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        chunked.groupBy(*keys, "_chunk")
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(by))).alias("_last"))
        .withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    )
    within = (
        Window.partitionBy(*keys, "_chunk").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        chunked.withColumn("_near", F.last("_value", ignorenulls=True).over(within))
        .join(carried, [*keys, "_chunk"])
        .withColumn(name, F.coalesce("_near", "_carried"))
        .drop("_value", "_chunk", "_near", "_carried")
    )


def dedup_first(df: DataFrame, key: str = "title_hash", order: str = "arrival") -> DataFrame:
    """The first record per title hash, in arrival order."""
    if key == "title_hash" and key not in df.columns:
        df = df.withColumn(key, title_hash(F.col("title")))
    return keep_ranked(df, [key], [F.col(order).asc(), F.col("id").asc()])


def dedup_last_by_id(df: DataFrame, order: str = "arrival") -> DataFrame:
    """Of batch rows that share an id, the one that arrived last."""
    return keep_ranked(df, ["id"], [F.col(order).desc(), F.col("title_hash").desc()])


def newest_per_feed(df: DataFrame, feed_cols: Sequence[str], n: int = 100,
                    order: str = "published_date") -> DataFrame:
    """At most ``n`` records per feed, newest by ``order`` first; ``feed_pos`` keeps their order."""
    return keep_ranked(df, feed_cols, [F.col(order).desc(), F.col("id").asc()], n, rank="feed_pos")
