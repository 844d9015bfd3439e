"""Reading the driver's tables, and shared-folder plumbing, for the queries here."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH = 8 << 20
#: Bytes of compressed rows of a bucket, about.
BUCKET = 32 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches between the JVM and Python in this session; texts can be long.

    A smaller setting of the session's owner stands.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH:
        spark.conf.set(key, f"{BATCH}b")


def release() -> None:
    """Give freed memory back to the system, which otherwise stays with the driver, or with a worker that is used again."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError, TypeError):
        pass  # another C library


def lean(scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The scan, whose worker gives back its memory when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(batches)
        release()

    return run


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share; it goes with the session.

    Only a local session without such a setting (tests, one machine) gets one; a cluster must name it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/checkpoints/tesserae"
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def settle(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    with shuffles_go(spark):
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile are deleted as soon as it is, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bucketed(df: DataFrame, column: str, label: str) -> DataFrame:
    """df, settled and then dealt by a column into buckets in the shared folder, so that joins on it leave these rows in place.

    As many buckets as the session has shuffle partitions, and more where one would exceed BUCKET bytes.
    """
    spark = df.sparkSession
    rows, path = settle(df, label)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), held // BUCKET + 1)
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    with shuffles_go(spark):
        rows.repartition(count, column).write.bucketBy(count, column).option("compression", "zstd").option("path", shared_dir(spark, label)).saveAsTable(name)
    remove(spark, path)
    return spark.table(name)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow file system and path of a folder URI."""
    if ":/" in uri or uri.startswith("/"):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri
