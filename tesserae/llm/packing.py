"""Hierarchical packing of documents into sequences of several context sizes.

A document is routed by its length: whole windows of the longest tier are cut off,
and the rest goes to the smallest tier that holds it. Each tier is packed in turn,
longest pieces first; a gap in a longer window is filled from the shorter tiers,
cutting the last filler so that the window is exactly full. What a task has left
at its end is split into windows of powers of two, so almost nothing is padded.
Windows of a tier are grouped into steps of equal token counts, and a step's windows
are dealt by attention cost (sum of squared piece lengths) so that steps are balanced.

Packing is local to an input partition and streams, holding POOL tokens, so it
needs no shuffle and a lost executor's partition is packed again alike.

Edge cases: null or empty text is the end id alone; repeated rows are packed each;
an empty table gives no pieces; a null doc_id is carried along; columns besides the
two named are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _tokens
from ._tables import read, small_batches

LENGTH, END = 2048, 1
#: Context sizes, longest first.
TIERS = (2048, 1024, 512, 256)
#: Tokens held before the tiers are packed, and tokens of a step group.
POOL, STEP = 1 << 21, 1 << 15

SCHEMA = "start bigint, length bigint, ids array<int>, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step bigint"


def route(n: int, tiers: tuple[int, ...] = TIERS) -> list[int]:
    """Lengths of the pieces of a document of n tokens: whole longest windows, and the rest."""
    whole, rest = divmod(n, tiers[0])
    return [tiers[0]] * whole + ([rest] if rest else [])


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS, last: bool = False) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """(sequences, leftover pieces) of documents of the given lengths.

    A sequence is (context size, [(document, start, length), ...]) and full. With
    last=True nothing is left over: the rest is cut at powers of two.
    """
    top = tiers[0]
    shelves: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
    full: list[tuple[int, list[tuple[int, int, int]]]] = []
    for d, n in enumerate(lengths):
        at = 0
        for piece in route(n, tiers):
            if piece == top:
                full.append((top, [(d, at, top)]))
            else:
                shelves[min(t for t in tiers if t >= piece)].append((d, at, piece))
            at += piece
    for shelf in shelves.values():
        shelf.sort(key=lambda p: p[2])  # the longest is taken first, from the end

    def fill(window: list[tuple[int, int, int]], room: int, below: tuple[int, ...]) -> int:
        """Fill room from the longest pieces of shorter tiers, cutting only the last."""
        for t in below:
            shelf = shelves[t]
            while room and shelf and shelf[-1][2] <= room:
                window.append(shelf.pop())
                room -= window[-1][2]
        for t in reversed(tiers):
            if room and shelves[t]:
                d, at, n = shelves[t].pop()
                if n <= room:
                    window.append((d, at, n))
                    room = fill(window, room - n, below)
                else:
                    window.append((d, at, room))
                    rest = (d, at + room, n - room)
                    home = shelves[min(x for x in tiers if x >= rest[2])]
                    k = next((i for i, p in enumerate(home) if p[2] >= rest[2]), len(home))
                    home.insert(k, rest)
                    room = 0
        return room

    held = sum(p[2] for s in shelves.values() for p in s)
    for k, t in enumerate(tiers):
        shelf = shelves[t]
        while shelf and held >= t:
            window = [shelf.pop()]
            room = fill(window, t - window[0][2], tiers[k:])
            if room:  # cannot be: enough tokens are held
                raise AssertionError("window left open")
            full.append((t, window))
            held -= t
    rest = [p for s in shelves.values() for p in s]
    if not last:
        return full, rest
    while rest:
        held = sum(p[2] for p in rest)
        size = 1 << (held.bit_length() - 1)
        window, room = [], size
        while room:
            d, at, n = rest.pop()
            window.append((d, at, min(n, room)))
            if n > room:
                rest.append((d, at + room, n - room))
            room -= window[-1][2]
        full.append((size, window))
    return full, []


def steps(sequences: list[tuple[int, list]], step: int = STEP) -> list[int]:
    """A step number for each sequence: steps of one size hold equal token counts and alike costs."""
    out = [0] * len(sequences)
    base = 0
    for size in sorted({s for s, _ in sequences}, reverse=True):
        own = sorted((i for i, s in enumerate(sequences) if s[0] == size), key=lambda i: -sum(p[2] ** 2 for p in sequences[i][1]))
        groups = max(1, -(-len(own) * size // step))
        for k, i in enumerate(own):
            lap, at = divmod(k, groups)
            out[i] = base + (at if lap % 2 == 0 else groups - 1 - at)
        base += groups
    return out


def pack_documents(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = END, tiers: tuple[int, ...] = TIERS, pool: int = POOL) -> DataFrame:
    """(id_col, SCHEMA): one row per piece, with its ids; sequence_id is unique, offset counts from 0 in it."""
    small_batches(df.sparkSession)
    path = path or _tokens.default_path()
    kind = df.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 36
        sequence = step_base = 0
        names: list = []
        tokens: list[np.ndarray] = []
        starts: list[int] = []
        totals: list[int] = []
        held = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, step_base, held
            full, rest = pack([t.size for t in tokens], tiers, last)
            step = steps(full)
            cols: list[list] = [[] for _ in range(9)]
            for (size, window), group in zip(full, step, strict=True):
                at = 0
                for d, s, n in window:
                    for c, v in zip(cols, (names[d], starts[d] + s, n, tokens[d][s : s + n], totals[d], base + sequence, at, size, base + step_base + group), strict=True):
                        c.append(v)
                    at += n
                sequence += 1
            step_base += max(step, default=-1) + 1
            for at in range(0, len(cols[0]), 2048):
                part = [c[at : at + 2048] for c in cols]
                flat = np.concatenate(part[3]).astype(np.int32)
                offs = np.concatenate([[0], np.cumsum([x.size for x in part[3]])]).astype(np.int32)
                arrays = [pa.array(part[0], name_type), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64()), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat)), pa.array(part[4], pa.int64()), pa.array(part[5], pa.int64()), pa.array(part[6], pa.int64()), pa.array(part[7], pa.int32()), pa.array(part[8], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, [id_col, *(x.split()[0] for x in SCHEMA.split(", "))])
            left = [(names[d], tokens[d][s : s + n], starts[d] + s, totals[d]) for d, s, n in rest]
            names[:], tokens[:], starts[:], totals[:] = ([x[k] for x in left] for k in range(4))
            held = sum(t.size for t in tokens)

        name_type = None
        for batch in batches:
            name_type = batch.column(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    t = np.append(_tokens.ids(text, path), np.uint32(end))
                    names.append(name)
                    tokens.append(t)
                    starts.append(0)
                    totals.append(t.size)
                    held += t.size
                if held >= pool:
                    yield from flush(False)
        if names:
            yield from flush(True)

    return df.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {kind}, {SCHEMA}")


def digest(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pieces with ids replaced by ids_crc32, the checksum of their little-endian unsigned 32-bit form."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("ids"))
            offs = col.offsets.to_numpy()
            flat = col.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            at = batch.schema.get_field_index("ids")
            cols = [*batch.columns[:at], pa.array(crc, pa.int64()), *batch.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(cols, [n if n != "ids" else "ids_crc32" for n in batch.schema.names])

    fields = ", ".join(f"`{f.name if f.name != 'ids' else 'ids_crc32'}` {f.dataType.simpleString() if f.name != 'ids' else 'bigint'}" for f in pieces.schema.fields)
    return pieces.mapInArrow(scan, fields)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    return digest(pack_documents(docs)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step")
