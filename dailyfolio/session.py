"""Session helpers: a tuned local session and the shared scratch folder."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SCRATCH_CONF = "spark.checkpoint.dir"
# Shuffle files of a query go as soon as it has ended, not when the driver's memory happens to be cleaned.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_folders: dict[str, str] = {}


def local_session(app: str = "dailyfolio", cores: int | str = "*", partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own (as in tests); on a cluster
    executors on other machines could not read it, so an unset folder is an error there.
    """
    configured = spark.conf.get(SCRATCH_CONF, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {SCRATCH_CONF} to a folder that every executor can reach")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="dailyfolio-")
    return _own_folders[context.applicationId]


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside leave no shuffle files behind: nothing reads them again."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_CONF) if before is None else spark.conf.set(CLEANUP_CONF, before)


def written(df, name: str):
    """``df`` written as a table in the scratch folder and read back.

    Cuts lineage through replicated storage, so the result outlives lost executors.
    """
    path = scratch_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df, *cols):
    """``df`` hash-partitioned by ``cols`` into the configured number of partitions.

    For packed rows that are exploded next: with the number given, AQE does not merge
    partitions by their packed size, which says little about the work in them.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)


def as_date(as_of: dt.date | str) -> dt.date:
    return dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of
