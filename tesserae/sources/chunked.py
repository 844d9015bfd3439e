"""A data source for chunked array folders: `.zarray` metadata and one file a chunk.

spark.read.format("chunked").load(path) gives (coordinates, value), one task a chunk.
Raw and zlib-compressed chunks in C order are read; a missing chunk is the fill value.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.grid import AXES2, AXES3


def _open(path: str):
    import pyarrow.fs as pafs

    fs, root = pafs.FileSystem.from_uri(path) if ":/" in path or path.startswith("/") else (pafs.LocalFileSystem(), path)
    return fs, root


def _read(path: str) -> bytes | None:
    fs, root = _open(path)
    if fs.get_file_info(root).size is None:
        return None
    with fs.open_input_stream(root) as f:
        return f.read()


def meta(path: str) -> dict:
    raw = _read(f"{path}/.zarray")
    if raw is None:
        raise FileNotFoundError(f"{path}/.zarray")
    m = json.loads(raw)
    if m.get("order", "C") != "C" or m.get("filters"):
        raise ValueError("only C order without filters is read")
    if m.get("compressor") and m["compressor"]["id"] not in ("zlib",):
        raise ValueError(f"no codec {m['compressor']['id']!r}")
    return m


class Chunk(InputPartition):
    def __init__(self, position: tuple[int, ...]):
        super().__init__(position)
        self.position = position


class ChunkedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.meta = path, meta(path)

    def partitions(self) -> list[Chunk]:
        counts = [-(-s // c) for s, c in zip(self.meta["shape"], self.meta["chunks"], strict=True)]
        return [Chunk(tuple(int(i) for i in p)) for p in np.ndindex(*counts)]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        m = self.meta
        sep = m.get("dimension_separator", ".")
        raw = _read(f"{self.path}/{sep.join(map(str, partition.position))}")
        kind = np.dtype(m["dtype"])
        if raw is None:
            data = np.full(m["chunks"], m.get("fill_value") or 0, kind)
        else:
            data = np.frombuffer(zlib.decompress(raw) if m.get("compressor") else raw, kind).reshape(m["chunks"])
        start = [p * c for p, c in zip(partition.position, m["chunks"], strict=True)]
        data = data[tuple(slice(0, s - b) for s, b in zip(m["shape"], start, strict=True))]
        at = np.indices(data.shape).reshape(data.ndim, -1)
        names = AXES3 if data.ndim == 3 else AXES2
        coords = [pa.array(x + b) for x, b in zip(at, start, strict=True)]
        yield pa.RecordBatch.from_arrays([*coords, pa.array(data.reshape(-1).astype(np.float64))], [*names, "value"])


class ChunkedSource(DataSource):
    """The data source named `chunked`."""

    @classmethod
    def name(cls) -> str:
        return "chunked"

    def schema(self) -> str:
        n = len(meta(self.options["path"])["shape"])
        return ", ".join([*(f"{a} long" for a in (AXES3 if n == 3 else AXES2)), "value double"])

    def reader(self, schema) -> ChunkedReader:
        return ChunkedReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChunkedSource)


def write_array(array: np.ndarray, path: str, chunks: tuple[int, ...], compress: bool = True) -> None:
    """A small local array as a folder of chunks, as the source reads them."""
    from pathlib import Path

    root = Path(path)
    root.mkdir(parents=True, exist_ok=True)
    info = {"zarr_format": 2, "shape": list(array.shape), "chunks": list(chunks), "dtype": array.dtype.str, "order": "C", "fill_value": 0, "filters": None, "compressor": {"id": "zlib", "level": 1} if compress else None}
    (root / ".zarray").write_text(json.dumps(info))
    for p in np.ndindex(*[-(-s // c) for s, c in zip(array.shape, chunks, strict=True)]):
        block = np.zeros(chunks, array.dtype)
        part = array[tuple(slice(i * c, (i + 1) * c) for i, c in zip(p, chunks, strict=True))]
        block[tuple(slice(0, s) for s in part.shape)] = part
        raw = block.tobytes()
        (root / ".".join(map(str, p))).write_bytes(zlib.compress(raw, 1) if compress else raw)
