"""Token ids in Arrow stream files of fixed-size-list batches.

Each file holds, in ascending order of documents, the ids of one range of them as
sequences of equal length, with a mask that is false on the padding of the file's
last sequence. Record batches are uncompressed and of equal row counts, so a memory
map gives any sequence, and any document, by arithmetic and without copying. Ids are
16-bit where the vocabulary allows. A second stream, beside it, has each document's
name, first id and length.

Ranges are dealt by id (Spark samples the bounds), as many as the text's bytes ask for, and each task writes its own pair
of files under the name of its range and renames them when they are whole, so an
executor's loss leaves no torn file and a repeated task writes the same bytes.

Edge cases: null or empty text is the end id alone; rows of equal id stand in order of
their text's digest (so that ranges can split them); a null id comes first; an empty table gives a folder with no files and no
rows; columns besides the two named are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _tokens
from ._tables import filesystem, read, settle, shared_dir, small_batches

END, LENGTH, ROWS = 0, 2048, 256
#: Bytes of text of a range, about; smaller where the session has more shuffle partitions than ranges of this size.
RANGE_BYTES = 64 << 20


def _write(fs: pafs.FileSystem, path: str, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> None:
    """A stream file that appears under its name only when it is whole."""
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as sink, pa.ipc.new_stream(sink, schema) as out:
        for b in batches:
            out.write_batch(b)
    fs.move(part, path)


class SequenceWriter:
    """Appends ids to a stream file of fixed-size lists and a mask."""

    def __init__(self, sink, width: int, length: int, rows: int):
        self.type = pa.uint16() if width <= 1 << 16 else pa.uint32()
        self.length, self.rows = length, rows
        self.schema = pa.schema([("ids", pa.list_(self.type, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.buffer: list[np.ndarray] = []
        self.held = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.buffer.append(ids.astype(self.type.to_pandas_dtype()))
        self.held += ids.size
        self.total += ids.size
        if self.held >= self.length * self.rows:
            self._batches(False)

    def _batches(self, last: bool) -> None:
        flat = np.concatenate(self.buffer) if self.buffer else np.zeros(0, self.type.to_pandas_dtype())
        whole = self.length * self.rows
        at = 0
        while flat.size - at >= whole or last and at < flat.size:
            part = flat[at : at + whole]
            at += part.size
            real = part.size
            part = np.pad(part, (0, -real % self.length))
            mask = np.arange(part.size) < real
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.buffer, self.held = [flat[at:]], flat.size - at

    def close(self) -> None:
        self._batches(True)
        self.out.close()


def write_tokens(df: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = END, length: int = LENGTH, rows: int = ROWS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write df's ids to folder; returns (range, documents, ids) of each file, in order of range."""
    small_batches(df.sparkSession)
    path = path or _tokens.default_path()
    kind = df.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        k = context.partitionId() if context else 0
        fs, root = filesystem(folder)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        fs.create_dir(root)
        width = _tokens.width(path)
        name, part = f"{root}/ids-{k:06d}.arrows", f"{root}/ids-{k:06d}.{uuid.uuid4().hex}.tmp"
        index: list[pa.RecordBatch] = []
        schema = pa.schema([("name", first.column(0).type), ("start", pa.int64()), ("n", pa.int64())])
        with fs.open_output_stream(part) as sink:
            out = SequenceWriter(sink, width, length, rows)
            batch = first
            while batch is not None:
                for at in range(0, batch.num_rows, 512):
                    piece = batch.slice(at, 512)
                    starts, sizes = [], []
                    for text in piece.column(1).to_pylist():
                        ids = np.append(_tokens.ids(text, path), np.uint32(end))
                        starts.append(out.total)
                        sizes.append(ids.size)
                        out.add(ids)
                    index.append(pa.RecordBatch.from_arrays([piece.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=schema))
                batch = next(batches, None)
            out.close()
        fs.move(part, name)
        _write(fs, f"{root}/docs-{k:06d}.arrows", schema, iter(index))
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([sum(b.num_rows for b in index)], pa.int64()), pa.array([out.total], pa.int64())], ["range", "documents", "ids"])

    spark = df.sparkSession
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    # equal ids, and rows without one, are told apart by digest, so that any number of them is split
    order = [F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))]
    docs = df.select(id_col, text_col).repartitionByRange(n, *order).sortWithinPartitions(*order, text_col)
    return settle(docs.mapInArrow(scan, "range bigint, documents bigint, ids bigint"), "token-ranges")[0]


class SequenceFile:
    """Random access to a stream file of fixed-size lists; arrays are views of the mapped file.

    All record batches but the last take equal bytes, so that of any sequence is read from a
    computed place; HELD batches are kept, whatever the file's size and file system.
    """

    HELD = 4

    def __init__(self, source):
        self._source, self._kept = source, {}
        first = pa.ipc.MessageReader.open_stream(source)
        self.schema = pa.ipc.read_schema(first.read_next_message())
        self.length = self.schema.field("ids").type.list_size
        self._start = source.tell()
        self.rows, self._bytes, self.count = 1, 1, 0
        if source.size() - self._start > 8:  # more than the end mark
            self.rows = pa.ipc.read_record_batch(first.read_next_message(), self.schema).num_rows
            self._bytes = source.tell() - self._start
            self.count = -(-(source.size() - self._start - 8) // self._bytes)

    def batch(self, k: int) -> pa.RecordBatch:
        if k not in self._kept:
            if len(self._kept) >= self.HELD:
                self._kept.pop(next(iter(self._kept)))
            self._source.seek(self._start + k * self._bytes)
            self._kept[k] = pa.ipc.read_record_batch(pa.ipc.read_message(self._source), self.schema)
        return self._kept[k]

    @property
    def batches(self) -> Iterator[pa.RecordBatch]:
        return (self.batch(k) for k in range(self.count))

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view) and mask of sequence i."""
        k, row = divmod(i, self.rows)
        at = row * self.length
        held = self.batch(k)
        return held.column("ids").values.to_numpy()[at : at + self.length], held.column("mask").values.slice(at, self.length)

    def ids(self, start: int, n: int) -> np.ndarray:
        """ids[start:start+n] of the file; a view where they lie in one batch."""
        whole = self.rows * self.length
        parts = []
        while n:
            k, at = divmod(start, whole)
            part = self.batch(k).column("ids").values.to_numpy()[at : at + n]
            parts.append(part)
            start, n = start + part.size, n - part.size
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def open_map(fs: pafs.FileSystem, path: str):
    """A memory map of a local file, else the file itself."""
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(path)
    return fs.open_input_file(path)


def read_tokens(ranges: DataFrame, folder: str, id_col: str, id_type: str) -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of every document, read from the files; start counts over all files."""
    spark = ranges.sparkSession
    before = F.coalesce(F.sum("ids").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = ranges.withColumn("before", before).select("range", "before")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for k, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_map(fs, f"{root}/ids-{k:06d}.arrows") as ids, open_map(fs, f"{root}/docs-{k:06d}.arrows") as docs:
                    held = SequenceFile(ids)
                    for part in pa.ipc.open_stream(docs):
                        crc = [zlib.crc32(held.ids(s, n).astype("<u4").tobytes()) for s, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                        start = pa.array(part.column(1).to_numpy() + base)
                        yield pa.RecordBatch.from_arrays([part.column(0), start, part.column(2), pa.array(crc, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "range").mapInArrow(scan, f"`{id_col}` {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def op10_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "tokens")
    ranges = write_tokens(read(spark, sf_dir, "documents"), folder)
    return read_tokens(ranges, folder, "doc_id", "bigint")
