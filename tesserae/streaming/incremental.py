"""Incremental feature tables: statistics of arriving blocks merged into what is held.

The statistics merge (counts, means, moments, extrema), so a stream of block tables is
folded batch by batch, exactly once for each batch: every batch writes a new version
folder named by its id, and a repeated batch rewrites the same one from the same base.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.features import merge_features

SCHEMA = "u bigint, v bigint, mean double, variance double, min double, max double, count bigint"


def merged(spark: SparkSession, path: str, version: int | None) -> DataFrame:
    """The feature table of a version; empty for none."""
    return spark.createDataFrame([], SCHEMA) if version is None else spark.read.schema(SCHEMA).parquet(f"{path}/version={version}")


def merge_stream(blocks: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ("u", "v")) -> StreamingQuery:
    """Folds a stream of edge features (SCHEMA) into versions under path."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        base = merged(batch.sparkSession, path, batch_id - 1 if batch_id else None)
        cols = [c.split()[0] for c in SCHEMA.split(", ")]
        out = merge_features(base.select(*cols).union(batch.select(*cols)), keys)
        out.select(*cols).write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return blocks.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def edge_means(samples: DataFrame) -> DataFrame:
    """Streaming means and counts of samples (u, v, value), for complete or update mode."""
    return samples.groupBy("u", "v").agg(F.avg("value").alias("mean"), F.count("*").alias("count"))
