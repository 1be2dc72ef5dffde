"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Batches of long rows end by their bytes, as 10,000 rows may be any size.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    # Sessions of one hot user are merged inside each input partition first.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # Streaming state lives on disk with a small memory footprint.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, app: str = "supportlens", **extra) -> SparkSession:
    """A session with the settings above; ``extra`` uses ``_`` for ``.`` in keys."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("_", "."), value)
    return ship_package(builder.getOrCreate())


def apply_settings(spark: SparkSession) -> SparkSession:
    """Give a session built elsewhere the settings above."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return ship_package(spark)


@cache
def _archive() -> str:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="supportlens-package-"), "supportlens")
    return shutil.make_archive(target, "zip", root, "supportlens")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Give this package to the workers, once per application; the driver serves the archive."""
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        spark.sparkContext.addPyFile(_archive())
        _SHIPPED.add(application)
    return spark


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="supportlens-")


#: Folders made inside the innermost ``work_scope``; none outside of one.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it lies; a missing one is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def work_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end, also after an error, the working folders that were made inside.

    A result that is used later has to be written before the end, to a folder made outside.
    An inner scope takes care of its own folders only.
    """
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            remove_folder(spark, path)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder; on a
    cluster the setting is required because executors must see the same files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_folder()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Spread a small table over all cores before work that is heavy per row.

    A table with at least one partition per core, as any large one has, is left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)


def work_tasks(spark: SparkSession) -> int:
    """Tasks for a shuffle of few bytes and much work, which adaptive execution would merge into a few."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where one cleaned frame feeds several passes: later passes prune columns,
    and a lost executor costs a re-read instead of the whole lineage. ``path`` names
    the folder instead of a new one.
    """
    spark = df.sparkSession
    path = path or work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
