"""Volumes in blocked form: one row a block, its labels (and values) as a flat array.

Where a volume is dense, a block's contacts are a few array comparisons, which is some
hundred times less work than a row for each voxel. A block carries a halo of one voxel
at its lower faces, so each contact is seen by exactly one block. Results are partial
sums by label pair, merged by an ordinary aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import Blocking, axes_of

#: begin: coordinates of the first own voxel; halo: 1 for each axis with a halo voxel before it.
SCHEMA = "block_id bigint, begin array<bigint>, shape array<int>, halo array<int>, labels array<bigint>, vals array<double>"


def to_blocks(vox: DataFrame, blocking: Blocking) -> DataFrame:
    """Blocked form of a dense long-form volume that fills the region of interest."""
    own = axes_of(vox)
    n = len(own)
    at = [F.floor((F.col(a) - b + s) / k) for a, b, s, k in zip(own, blocking.begin, blocking.shift, blocking.block, strict=True)]
    out = vox
    for k, (a, c) in enumerate(zip(own, at, strict=True)):
        # the last voxel of a block along an axis is the halo of the next
        last = ((F.col(a) - blocking.begin[k] + blocking.shift[k] + 1) % blocking.block[k] == 0) & (c + 1 < blocking.per_axis[k])
        out = out.withColumn(f"__p{k}", F.explode(F.when(last, F.array(c, c + 1)).otherwise(F.array(c))))
    block = F.lit(0).cast("long")
    for k in range(n):
        block = block * blocking.per_axis[k] + F.col(f"__p{k}")
    key = F.struct(*own, "label", "value")
    g = out.groupBy(block.alias("block_id"), *[f"__p{k}" for k in range(n)]).agg(F.array_sort(F.collect_list(key)).alias("v"), *[F.min(a).alias(f"__lo{k}") for k, a in enumerate(own)], *[F.max(a).alias(f"__hi{k}") for k, a in enumerate(own)])
    begin = [F.greatest(F.col(f"__p{k}") * blocking.block[k] + blocking.begin[k] - blocking.shift[k], F.lit(blocking.begin[k])).cast("long") for k in range(n)]
    halo = [(F.col(f"__lo{k}") < begin[k]).cast("int") for k in range(n)]
    shape = [(F.col(f"__hi{k}") - F.col(f"__lo{k}") + 1).cast("int") for k in range(n)]
    return g.select("block_id", F.array(*begin).alias("begin"), F.array(*shape).alias("shape"), F.array(*halo).alias("halo"), F.col("v.label").alias("labels"), F.col("v.value").alias("vals"))


def _arrays(batch: pa.RecordBatch, with_values: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray | None, list[int]]]:
    shapes, halos, labels = (batch.column(batch.schema.get_field_index(c)) for c in ("shape", "halo", "labels"))
    ids = batch.column(batch.schema.get_field_index("block_id")).to_pylist()
    values = batch.column(batch.schema.get_field_index("vals")) if with_values else None
    for i in range(batch.num_rows):
        shape = shapes[i].as_py()
        v = values[i].values.to_numpy().reshape(shape) if with_values else None
        yield ids[i], labels[i].values.to_numpy().reshape(shape), v, halos[i].as_py()


def _ranked(arr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's labels in order, and their ranks in place of them: a pair of ranks fits one number, whatever the labels."""
    low, span = int(arr.min()), int(arr.max()) - int(arr.min()) + 1
    if span <= 4 * arr.size:  # a table of labels instead of a sort
        seen = np.zeros(span, bool)
        seen[(arr - low).ravel()] = True
        return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[arr - low]
    names, ranks = np.unique(arr, return_inverse=True)
    return names, ranks.reshape(arr.shape)


def _zero(names: np.ndarray, ignore: bool) -> int | None:
    """The rank of label 0, if that is to be ignored and there."""
    at = int(np.searchsorted(names, 0))
    return at if ignore and at < names.size and names[at] == 0 else None


def _contacts(arr: np.ndarray, halo: list[int], ignore: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, tuple, tuple]]:
    """For each axis: where labels differ, the lower and the upper label, and the slices of both sides."""
    inner = tuple(slice(h, None) for h in halo)
    for k in range(arr.ndim):
        low = tuple(slice(0, -1) if j == k else inner[j] for j in range(arr.ndim))
        up = tuple(slice(1, None) if j == k else inner[j] for j in range(arr.ndim))
        a, b = arr[low], arr[up]
        differ = a != b
        if ignore is not None:
            differ &= (a != ignore) & (b != ignore)
        yield differ, a[differ], b[differ], low, up


def region_graph(blocks: DataFrame, ignore_label: bool = False) -> DataFrame:
    """(u, v) of touching labels; each block sends its distinct pairs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, arr, _, halo in _arrays(batch, False):
                names, ranks = _ranked(arr)
                keys = [np.unique(np.minimum(a, b) * names.size + np.maximum(a, b)) for _, a, b, _, _ in _contacts(ranks, halo, _zero(names, ignore_label))]
                key = np.unique(np.concatenate(keys))
                yield pa.RecordBatch.from_arrays([pa.array(names[key // names.size]), pa.array(names[key % names.size])], ["u", "v"])

    return blocks.select("block_id", "shape", "halo", "labels").mapInArrow(scan, "u bigint, v bigint").distinct()


def block_sums(blocks: DataFrame, ignore_label: bool = False) -> DataFrame:
    """(block_id, u, v, n, s1, s2, min, max): sums over both values of every contact."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, arr, val, halo in _arrays(batch, True):
                names, ranks = _ranked(arr)
                keys, x = [], []
                for differ, a, b, low, up in _contacts(ranks, halo, _zero(names, ignore_label)):
                    k = np.minimum(a, b) * names.size + np.maximum(a, b)
                    keys += [k, k]
                    x += [val[low][differ], val[up][differ]]
                key, back = np.unique(np.concatenate(keys), return_inverse=True)
                v = np.concatenate(x)
                low_, high = np.full(key.size, np.inf), np.full(key.size, -np.inf)
                np.minimum.at(low_, back, v)
                np.maximum.at(high, back, v)
                cols = [np.full(key.size, block), names[key // names.size], names[key % names.size], np.bincount(back, minlength=key.size), np.bincount(back, v, key.size), np.bincount(back, v * v, key.size), low_, high]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["block_id", "u", "v", "n", "s1", "s2", "min", "max"])

    return blocks.mapInArrow(scan, "block_id bigint, u bigint, v bigint, n bigint, s1 double, s2 double, min double, max double")


def edge_features(blocks: DataFrame, ignore_label: bool = False) -> DataFrame:
    """(u, v, mean, variance, min, max, count) of boundary values, merged from block sums."""
    n = F.sum("n")
    mean = F.sum("s1") / n
    return block_sums(blocks, ignore_label).groupBy("u", "v").agg(mean.alias("mean"), (F.sum("s2") / n - mean * mean).alias("variance"), F.min("min").alias("min"), F.max("max").alias("max"), n.alias("count"))
