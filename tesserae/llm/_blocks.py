"""A store of documents in blocks, and streaming passes over one block at a time.

Texts are written once to the shared folder, partitioned by block. Later passes
bring small control rows to a block and read its texts from there, so long texts
are not shuffled, and any pass can be repeated when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import filesystem, lean, settle, small_batches

ROW_BITS = 33
#: (blk, kind, a, b): what a pass is told about a block.
CONTROL = "blk int, kind int, a bigint, b bigint"


class Blocks:
    """Rows of a DataFrame as columns __blk, __row and its own, in the shared folder."""

    def __init__(self, df: DataFrame, label: str):
        small_batches(df.sparkSession)
        at = F.monotonically_increasing_id()
        held = df.withColumn("__blk", F.spark_partition_id()).withColumn("__row", at.bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
        self.df, self.path = settle(held, label, ("__blk",))
        self.blocks = self.df.select("__blk").distinct()
        self.count = max(1, self.blocks.count())

    def every(self) -> DataFrame:
        """One control row of kind 0 for each block, so that all are visited."""
        zero = F.lit(0).cast("long")
        return self.blocks.select(F.col("__blk").alias("blk"), F.lit(0).alias("kind"), zero.alias("a"), zero.alias("b"))

    @property
    def place(self) -> Column:
        """One number for a row's block and row."""
        return F.col("__blk").cast("long") * (1 << ROW_BITS) + F.col("__row")

    @staticmethod
    def told(places: DataFrame, column: str) -> DataFrame:
        """Control rows of kind 1 that name rows by place."""
        row = F.col(column).bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("a")
        return places.select(F.shiftright(column, ROW_BITS).cast("int").alias("blk"), F.lit(1).alias("kind"), row, F.lit(0).cast("long").alias("b"))

    def chosen(self, places: DataFrame, column: str, columns: list[str], with_place: bool = True) -> DataFrame:
        """Columns of the named rows, read in their blocks; with_place puts the place before them."""

        def choose(blk: int, told: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = np.sort(told[1][0])
            for batch in batches:
                at = batch.column(0).to_numpy()
                mask = np.isin(at, rows, assume_unique=True)
                if mask.any():
                    if with_place:
                        batch = batch.set_column(0, column, pa.array(at + (blk << ROW_BITS)))
                    yield batch.filter(pa.array(mask)).select([*([column] if with_place else []), *columns])

        kinds = [f"{n} {self.df.schema[n].dataType.simpleString()}" for n in columns]
        return self.over(self.told(places, column), columns, choose, ", ".join([*([f"{column} bigint"] if with_place else []), *kinds]))

    def over(self, control: DataFrame, columns: list[str], work: Callable[[int, dict, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """work(block, {kind: (a, b)}, its batches) for each block that control names."""
        path, wanted = self.path, ["__row", *columns]

        def batches(blk: int) -> Iterator[pa.RecordBatch]:
            fs, root = filesystem(path)
            files = fs.get_file_info(pafs.FileSelector(f"{root}/__blk={blk}"))
            for info in sorted((f for f in files if f.path.endswith(".parquet")), key=lambda f: f.path):
                with fs.open_input_file(info.path) as source:
                    yield from pq.ParquetFile(source).iter_batches(1024, columns=wanted)

        def one(blk: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(parts)
            kind, a, b = (rows.column(k).to_numpy() for k in (1, 2, 3))
            told = {int(k): (a[kind == k], b[kind == k]) for k in np.unique(kind)}
            yield from work(blk, told, batches(blk))

        def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, parts = None, []
            for batch in stream:
                blk = batch.column(0).to_numpy()
                cut = [0, *(np.flatnonzero(blk[1:] != blk[:-1]) + 1).tolist(), blk.size] if blk.size else []
                for x, y in zip(cut, cut[1:], strict=False):
                    if now is not None and blk[x] != now:
                        yield from one(now, parts)
                        parts = []
                    now = int(blk[x])
                    parts.append(batch.slice(x, y - x))
            if now is not None:
                yield from one(now, parts)

        dealt = control.repartition(4 * self.count, "blk").sortWithinPartitions("blk")
        return dealt.mapInArrow(lean(scan), schema)
