"""Vectorised byte-level scanning of Arrow text columns, shared by the operators here.

Everything works on the contiguous value buffer of an Arrow string array, so a
batch of texts is scanned by a handful of numpy passes instead of a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
CHUNK_BYTES = (1 << 20) - 64


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i below n at least."""
    if _POW[0].size < n:
        size = 1 << int(n - 1).bit_length()
        for k, b in enumerate((int(BASE), _inverse(int(BASE)))):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            _POW[k] = np.multiply.accumulate(out)
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads entropy over all 64 bits (in place)."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix polynomial of bytes, one longer than data."""
    pw, _ = powers(data.size + 1)
    out = np.empty(data.size + 1, np.uint64)
    out[0] = 0
    t = data.astype(np.uint64)
    t += np.uint64(1)
    t *= pw[: data.size]
    np.cumsum(t, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end) for each pair, from prefix_sums(data)."""
    _, inv = powers(prefix.size)
    h = prefix[end] - prefix[start]
    h *= inv[start]
    h += (end - start).astype(np.uint64)
    return mix(h)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null is read as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type) or pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("" if "string" in str(col.type) else b"")
    wide = "large" in str(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of documents of at most `limit` bytes together (or one document)."""
    a, n = 0, offs.size - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b
        a = b


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a batch in bounded pieces."""
    data, offs = buffers(batch.column(batch.schema.get_field_index(column)))
    for a, b in chunks(offs, limit):
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


def table(chars: Iterable[int]) -> np.ndarray:
    """Look-up table over byte values, true for the given ones."""
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: ASCII letters, digits and every byte of a non-ASCII character.
WORD = table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
LETTER = table([*range(65, 91), *range(97, 123), *range(128, 256)])
SPACE = table([32, *range(9, 14)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(flag: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of maximal true runs; runs never cross a document boundary."""
    if flag.size == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(flag)
    before[0] = False
    before[1:] = flag[:-1]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < flag.size)]
    before[inner] = False
    after = np.empty_like(flag)
    after[-1] = False
    after[:-1] = flag[1:]
    after[inner - 1] = False
    return np.flatnonzero(flag & ~before), np.flatnonzero(flag & ~after) + 1


def owner(offs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Document number of each byte position."""
    return np.searchsorted(offs, at, "right") - 1
