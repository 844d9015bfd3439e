"""Volumes on disk: blocked tables, and a Python data source for chunked array folders.

A volume is a Parquet table partitioned by block, so a region of interest is read by
partition pruning on block_id and pushed-down ranges on coordinates. Label multisets
are a table of (block, label, count) whose largest count is the voxel's label.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import Blocking, axes_of


def write_volume(vox: DataFrame, path: str, blocking: Blocking) -> None:
    """Write voxels by block, with the tiling beside them."""
    own = axes_of(vox)
    vox.withColumn("block_id", blocking.block_id([F.col(a) for a in own])).repartition("block_id").write.mode("overwrite").partitionBy("block_id").parquet(path)
    meta = {"begin": blocking.begin, "end": blocking.end, "block": blocking.block, "shift": blocking.shift}
    vox.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/_meta")


def volume_info(spark: SparkSession, path: str) -> Blocking:
    """The tiling of a volume: its shape and chunk shape."""
    meta = json.loads(spark.read.text(f"{path}/_meta").first()[0])
    return Blocking(meta["begin"], meta["end"], meta["block"], meta["shift"])


def read_volume(spark: SparkSession, path: str, begin: Sequence[int] | None = None, end: Sequence[int] | None = None) -> DataFrame:
    """Voxels of a region of interest: only its blocks' files are opened."""
    vox = spark.read.parquet(path)
    own = axes_of(vox)
    if begin is None or end is None:
        return vox.drop("block_id")
    b = volume_info(spark, path)
    spans = [range(max(0, (lo - o + s) // k), min(n, -(-(hi - o + s) // k))) for lo, hi, o, s, k, n in zip(begin, end, b.begin, b.shift, b.block, b.per_axis, strict=True)]
    ids = [0]
    for span, n in zip(spans, b.per_axis, strict=True):
        ids = [i * n + p for i in ids for p in span]
    out = vox.where(F.col("block_id").isin(ids))
    for a, lo, hi in zip(own, begin, end, strict=True):
        out = out.where((F.col(a) >= lo) & (F.col(a) < hi))
    return out.drop("block_id")


def write_region(vox: DataFrame, path: str) -> None:
    """Replace the blocks that vox touches; other blocks stay. vox must hold whole blocks."""
    spark = vox.sparkSession
    own = axes_of(vox)
    b = volume_info(spark, path)
    rows = vox.withColumn("block_id", b.block_id([F.col(a) for a in own])).repartition("block_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block_id").parquet(path)


#: Blocks of a graph that share a folder.
GROUP = 1024


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges (with block_id: by block, many blocks a folder and in order, so that statistics tell them apart)."""
    for df, name in ((nodes, "nodes"), (edges, "edges")):
        if "block_id" in df.columns:
            df = df.withColumn("block_group", F.floor(F.col("block_id") / GROUP)).repartition("block_group").sortWithinPartitions("block_group", "block_id")
            df.write.mode("overwrite").partitionBy("block_group").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, blocks: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges), of some blocks only if wanted: only their folders' files are opened."""

    def read(name: str) -> DataFrame:
        df = spark.read.parquet(f"{path}/{name}")
        if "block_group" not in df.columns:
            return df
        if blocks is not None:
            df = df.where(F.col("block_group").isin(sorted({b // GROUP for b in blocks})) & F.col("block_id").isin(list(blocks)))
        return df.drop("block_group")

    return read("nodes"), read("edges")


def read_dense_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes with their dense number, edges between numbers)."""
    from ..operators.lookup import make_dense

    nodes, edges = read_graph(spark, path)
    ids = make_dense(nodes.select("node").distinct(), "node")
    out = edges.join(ids.select(F.col("node").alias("u"), F.col("dense").alias("a")), "u").join(ids.select(F.col("node").alias("v"), F.col("dense").alias("b")), "v")
    return ids, out.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def write_overlaps(overlaps: DataFrame, path: str) -> None:
    overlaps.write.mode("overwrite").parquet(path)


def read_overlaps(spark: SparkSession, path: str, begin: int | None = None, end: int | None = None) -> DataFrame:
    """Overlaps (a, b, cnt), of a range of labels only if wanted."""
    out = spark.read.parquet(path)
    return out if begin is None else out.where((F.col("a") >= begin) & (F.col("a") < end))


def read_transformix(spark: SparkSession, path: str) -> DataFrame:
    """(id, y, x or z, y, x as doubles): output points of a point-transformation log."""
    lines = spark.read.text(path)
    numbers = F.regexp_extract_all(F.regexp_extract("value", r"OutputPoint = \[([^\]]*)\]", 1), F.lit(r"([-+0-9.eE]+)"), F.lit(1))
    out = lines.where(F.col("value").contains("OutputPoint")).select(F.regexp_extract("value", r"Point\s+(\d+)", 1).cast("long").alias("id"), numbers.alias("p"))
    p = F.col("p")
    # points are written x first
    return out.select("id", F.when(F.size(p) == 3, p[2]).cast("double").alias("z"), p[1].cast("double").alias("y"), p[0].cast("double").alias("x"))


def multiset_labels(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, label): the label of largest count of each multiset voxel; the smallest of ties."""
    return entries.groupBy(*keys).agg(F.max_by("label", F.struct("cnt", (-F.col("label")).alias("n"))).alias("label"))
