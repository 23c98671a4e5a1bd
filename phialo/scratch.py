"""Tables that cut lineage, in the folder that the cluster shares.

``spark.checkpoint.dir`` names the folder.  Only where it is unset and Spark runs on one
machine (tests, a laptop) is a folder of that machine set, once for the session; on a cluster
without it there is no place that all executors see, and that is an error.

A table's rows are read from its files alone, so a lost executor costs nothing that was
stored.  ``drop`` deletes tables that nothing reads any more; the others go with the session.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: With it, shuffle files go when the job that wrote them has ended, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        shared = "file://" + tempfile.mkdtemp(prefix="phialo-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Jobs in which shuffle files go when the job ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def place(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes with the session."""
    path = f"{folder(spark)}/phialo-{uuid.uuid4().hex}"
    at, files = _hadoop(spark, path)
    files.deleteOnExit(at)
    return path


def table(df: DataFrame, name: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and return the stored rows."""
    spark = df.sparkSession
    parent = f"{folder(spark)}/phialo-{uuid.uuid4().hex}"
    path = f"{parent}/{name}"
    # small row groups: a table that few tasks wrote is read by many
    writer = df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_go(spark):
        writer.parquet(path)
    at, files = _hadoop(spark, parent)
    files.deleteOnExit(at)
    stored = spark.read.schema(df.schema).parquet(path)
    _paths[stored] = parent
    return stored


def drop(*tables: DataFrame) -> None:
    """Delete what ``table`` stored; a DataFrame that reads one of them is of no use any more."""
    for stored in tables:
        if parent := _paths.pop(stored, None):
            at, files = _hadoop(stored.sparkSession, parent)
            files.delete(at, True)
            files.cancelDeleteOnExit(at)
