"""Bounded labelled samples, and scoring of whole tables with a fitted model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import small_batches
from ._text import text_chunks


def held_out(column: str, modulus: int, remainder: int) -> F.Column:
    """crc32 of the id as text leaves the remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == remainder, F.lit(False))


def bounded(rows: DataFrame, label: str, key: str, bound: int) -> DataFrame:
    """About `bound` rows of each label at most, chosen by a hash of the key.

    The share is set from the label's count, so the sample's size is bounded in
    expectation whatever the table's, and one scan draws it.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    steps = 1 << 20
    share = F.lit(0)
    for value, n in counts.items():
        share = F.when(F.col(label) == value, F.lit(min(steps, int(steps * bound / n)))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(steps)) < share)


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable: F.Column, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of a bounded sample; the labels' side is small enough to broadcast by its bound."""
    chosen = bounded(labels.where(usable & F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).alias("label")).distinct(), "label", "id", bound)
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")


class Rows:
    """Sparse rows: offsets and feature numbers, with labels, in a fixed order."""

    def __init__(self, features: list[np.ndarray], labels: np.ndarray):
        self.offs = np.concatenate([[0], np.cumsum([f.size for f in features])]).astype(np.int64)
        self.flat = np.concatenate(features) if features else np.zeros(0, np.int64)
        self.labels = labels

    def __len__(self) -> int:
        return self.labels.size

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features, row number within the selection) of some rows."""
        size = (self.offs[1:] - self.offs[:-1])[rows]
        at = np.repeat(self.offs[rows], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return self.flat[at], np.repeat(np.arange(rows.size), size)


def gather(sample: DataFrame, featurise: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], label_type: str) -> tuple[list[np.ndarray], list]:
    """Features and labels of a bounded sample, computed on executors, ordered by id and text digest."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in text_chunks(batch, "text"):
                rows = featurise(data, offs)
                ends = np.concatenate([[0], np.cumsum([r.size for r in rows])]).astype(np.int32)
                flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)], ["features", "label", "place"])

    small_batches(sample.sparkSession)
    found = sample.select("text", "label", F.xxhash64("id", "text").alias("place")).mapInArrow(scan, f"features array<int>, label {label_type}, place bigint").toArrow()
    found = found.sort_by([("place", "ascending")])
    col = found.column("features").combine_chunks()
    offs, flat = col.offsets.to_numpy(), col.values.to_numpy()
    return [flat[x:y] for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], found.column("label").to_pylist()


def sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of values[begin:end) for each pair, in order and without gaps between cumulative errors of floats."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[end] - total[begin]
