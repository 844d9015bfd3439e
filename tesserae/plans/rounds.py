"""Materialised rounds for iterative plans.

Each round is written to the folder of spark.checkpoint.dir and read back, which cuts
lineage and survives lost executors; the round before is deleted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; it goes with the session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/checkpoints/tesserae"
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    fs, at = _folder(spark, path)
    fs.deleteOnExit(at)
    return path


def keep(df: DataFrame, label: str = "round") -> DataFrame:
    """df, written and read back; its path is the attribute `kept_at`."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def drop(df: DataFrame) -> None:
    if path := getattr(df, "kept_at", None):
        fs, at = _folder(df.sparkSession, path)
        fs.delete(at, True)
