"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import remove, settle

#: Links that one task joins by itself (16 bytes each); more are contracted in rounds. Both ways are exact.
SMALL = 1 << 20


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links between n rows, as rows and their smallest row."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, before, root)
        root = root[root]
        if np.array_equal(before, root):
            own = np.flatnonzero(root != np.arange(n))
            return own, root[own]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [np.stack([c.to_numpy() for c in b.columns]) for b in batches if b.num_rows]
    if not parts:
        return
    names, at = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    own, root = forest(a, b, names.size)
    yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(names[root])], ["a", "b"])


def components(edges: DataFrame, label: str = "components", small: int = SMALL) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node reached.

    edges: columns a, b (long). Each round reads and writes links only, with
    minima pre-aggregated before the shuffle and joins that AQE can split, so a
    hub never gathers in one task. No more than `small` links are joined by one task
    instead. Self links and empty tables give no rows.
    """
    spark = edges.sparkSession
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, path = settle(e, label)
    if e.count() <= small:
        e, _ = settle(e.coalesce(1).mapInArrow(_joined, "a bigint, b bigint"), label)
        remove(spark, path)
        return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    mark = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        tops = large.where("a <> b").distinct()
        least = tops.groupBy("a").agg(F.min("b").alias("m"))
        small = tops.join(least, "a")
        new = small.where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        new, new_path = settle(new, label)
        now = new.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        remove(spark, path)
        e, path = new, new_path
        if now == mark:
            break
        mark = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
