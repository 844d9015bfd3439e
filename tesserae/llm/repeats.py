"""Exact removal of byte strings that occur more than once, by blockwise suffix sorting.

A byte goes if a 200-byte string that covers it also starts anywhere else, in the
same document or another; strings are judged on the input. The plan has four passes
over blocks of documents, none of which shuffles texts:

1. Each 200-byte window picks its least 100-byte string (by hash, leftmost of ties)
   as anchor. Equal windows pick equal anchors at equal places, so an anchor that
   occurs once owns no repeated window. Blocks send their distinct anchors only.
2. For anchors that occur twice, blocks send the bytes of the windows they own,
   equal ones once, keyed by 150 bytes that all windows of a row share.
   Of anchors that occur more than HOT times (a line that very many texts share), windows
   are first told apart by STEP neighbouring starts at a time: blocks send the hashes of the
   bytes that those share, and bytes only where such a hash occurs twice.
3. Rows of a key form a suffix bucket. Equal rows arrive together and are merged in passing,
   so a task holds the distinct ones only. It is sorted with a difference cover, whose
   sample ranks settle long ties (suffixes.py); classes of two or more are repeats.
4. Blocks cut their own documents.

Whole texts that occur twice are recognised by digest, and go through 1 to 3 once.

Edge cases: a null text is an empty one, and texts under 200 bytes only lose
nothing; an empty table gives no rows; repeated rows are copies of each other and
lose everything; other columns pass through, but those named like a column of the
result (RESULT) give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ._blocks import Blocks
from ._tables import read, settle
from ._text import CHUNK_BYTES, mix, powers, prefix_sums, range_hash, text_chunks
from .suffixes import sort_suffixes

LENGTH = 200
#: Bytes of suffix bucket sorted at once.
BUCKET_BYTES = 1 << 19
#: Bytes of a text scanned at once.
PIECE_BYTES = 1 << 20
#: Occurrences of an anchor from which its windows are told apart more finely, and starts taken together then.
HOT, STEP = 4096, 10
RESULT = ("kept", "n_bytes", "n_removed", "n_spans", "absent")
_LOW = np.uint64(0xFFFFFFFF)


def _segments(data: np.ndarray, offs: np.ndarray, skip: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts that share an anchor: (first, last, anchor, hash), and the prefix sums."""
    gram = length // 2
    none = np.zeros(0, np.int64)
    prefix = prefix_sums(data)
    if data.size < length:
        return none, none, none, none.astype(np.uint64), prefix
    _, inv = powers(data.size + 1)
    h = prefix[gram:] - prefix[:-gram]
    h *= inv[: h.size]
    mix(h)
    low = h & ~_LOW
    low |= np.arange(h.size, dtype=np.uint64)
    span, wide = 1, length - gram + 1
    while 2 * span <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wide:
        low = np.minimum(low[: low.size - (wide - span)], low[wide - span :])
    chosen = (low & _LOW).astype(np.int64)
    valid = np.ones(chosen.size, bool)
    for b in offs[1:-1].tolist():
        valid[max(0, b - length + 1) : b] = False
    for d in np.flatnonzero(skip).tolist():
        valid[offs[d] : offs[d + 1]] = False
    start = np.flatnonzero(valid)
    if not start.size:
        return none, none, none, none.astype(np.uint64), prefix
    own = chosen[start]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)]))
    end = np.append(new[1:], start.size) - 1
    return start[new], start[end], own[new], h[own[new]], prefix


def _pieces(batch: pa.RecordBatch, length: int, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(rows, bytes, offsets, base) of a batch in bounded pieces.

    A text longer than a piece is cut into several that overlap by all but one byte of a
    window, so each window lies in one of them; base is where the piece begins in its text.
    """
    rows = batch.column(0).to_numpy()
    for a, b, data, offs in text_chunks(batch, "text", min(CHUNK_BYTES, piece)):
        if data.size <= piece:
            yield rows[a:b], data, offs, 0
            continue
        for at in range(0, data.size, piece):
            part = data[at : at + piece + length - 1]
            yield rows[a:b], part, np.array([0, part.size]), at


def _counted(found: list[np.ndarray], blk: int) -> Iterator[pa.RecordBatch]:
    """(h, blk, n): distinct hashes of a block and how often they were found there."""
    h, n = np.unique(np.concatenate(found), return_counts=True)
    for at in range(0, h.size, 1 << 16):
        part = h[at : at + (1 << 16)].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(part.size, blk, np.int32)), pa.array(n[at : at + (1 << 16)])], ["h", "blk", "n"])


def _anchor_pass(length: int, piece: int):
    def work(blk: int, told: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip = np.sort(told.get(1, (np.zeros(0, np.int64),))[0])
        found = []
        for batch in batches:
            for rows, data, offs, _ in _pieces(batch, length, piece):
                found.append(_segments(data, offs, np.isin(rows, skip), length)[3])
        if found:
            yield from _counted(found, blk)

    return work


def _member(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not sorted_.size:
        return np.zeros(x.size, bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), sorted_.size - 1)] == x


def _fine(first: np.ndarray, last: np.ndarray, anchor: np.ndarray, prefix: np.ndarray, length: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts cut at every `step` from the anchor, and the hash of what the windows of a step share."""
    a, b = (first - anchor) // step, (last - anchor) // step
    n = b - a + 1
    own = np.repeat(np.arange(n.size), n)
    k = a[own] + np.arange(own.size) - np.repeat(np.cumsum(n) - n, n)
    low = anchor[own] + k * step
    key = range_hash(prefix, low + step - 1, low + length) + k.astype(np.uint64)
    return np.maximum(first[own], low), np.minimum(last[own], low + step - 1), mix(key)


def _fine_pass(length: int, piece: int, step: int):
    """Counts, in each block, the shared bytes of neighbouring windows of hot anchors (kind 4)."""

    def work(blk: int, told: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if 4 not in told:
            return
        skip, hot = np.sort(told.get(1, (np.zeros(0, np.int64),))[0]), np.sort(told[4][0].view(np.uint64))
        found = []
        for batch in batches:
            for rows, data, offs, _ in _pieces(batch, length, piece):
                first, last, anchor, h, prefix = _segments(data, offs, np.isin(rows, skip), length)
                mine = _member(hot, h)
                found.append(np.unique(_fine(first[mine], last[mine], anchor[mine], prefix, length, step)[2], return_counts=True))
        if found:
            # a hash that a part holds twice counts as often
            yield from _counted([np.repeat(h, np.minimum(n, 2)) for h, n in found], blk)

    return work


def _context_pass(length: int, piece: int, step: int):
    half = length // 4

    def work(blk: int, told: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64),)
        skip = np.sort(told.get(1, none)[0])
        wanted, hot, fine = (np.sort(told.get(k, none)[0].view(np.uint64)) for k in (2, 4, 5))
        held: dict[tuple[int, bytes], tuple[list[int], list[int]]] = {}
        size = 0
        if not wanted.size and not fine.size:
            return

        def flush() -> Iterator[pa.RecordBatch]:
            items = list(held.items())
            for at in range(0, len(items), 4096):
                part = items[at : at + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k, _ in part], pa.int64()), pa.array([k[1] for k, _ in part], pa.binary()), pa.array([blk] * len(part), pa.int32()), pa.array([v[0] for _, v in part], pa.list_(pa.int64())), pa.array([v[1] for _, v in part], pa.list_(pa.int64()))],
                    ["key", "bytes", "blk", "rows", "starts"],
                )
            held.clear()

        for batch in batches:
            for rows, data, offs, base in _pieces(batch, length, piece):
                every = _segments(data, offs, np.isin(rows, skip), length)
                prefix, mine = every[4], _member(wanted, every[3])
                first, last, anchor = (x[mine] for x in every[:3])
                left = first <= anchor - half
                right = last > anchor - half
                pieces = [
                    (first[left], np.minimum(last, anchor - half)[left], range_hash(prefix, anchor[left] - half, anchor[left] + length // 2)),
                    (np.maximum(first, anchor - half + 1)[right], last[right], range_hash(prefix, anchor[right], anchor[right] + length // 2 + half) + np.uint64(1)),
                ]
                if fine.size:
                    mine = _member(hot, every[3])
                    x, y, key = _fine(*(v[mine] for v in every[:3]), prefix, length, step)
                    mine = _member(fine, key)
                    pieces.append((x[mine], y[mine], key[mine]))
                whole = data.tobytes()
                for x, y, key in pieces:
                    doc = np.searchsorted(offs, x, "right") - 1
                    for s, e, k, r, o in zip(x.tolist(), (y + length).tolist(), key.view(np.int64).tolist(), rows[doc].tolist(), (x - offs[doc] + base).tolist(), strict=True):
                        text = whole[s:e]
                        if (at_ := held.get((k, text))) is None:
                            at_ = held[k, text] = ([], [])
                            size += e - s
                        at_[0].append(r)
                        at_[1].append(o)
                        size += 16
                if size > 1 << 24:
                    yield from flush()
                    size = 0
        yield from flush()

    return work


def _repeated(texts: list[bytes], weight: np.ndarray, length: int, bucket: int) -> list[np.ndarray]:
    """For each text, which of its window starts hold a string that occurs twice (texts count by weight)."""
    size = np.array([len(t) for t in texts], np.int64)
    offs = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    windows = size - length + 1
    base = np.repeat(offs[:-1] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
    start = np.arange(int(windows.sum())) + base
    heavy = np.repeat(weight, windows)
    flag = np.zeros(start.size, bool)
    if data.size <= 4 * bucket:
        _, cls = sort_suffixes(data, start, length)
        flag = np.bincount(cls, heavy)[cls] > 1
    else:  # one key with very many texts: its suffixes by hash of the window, a bounded part at a time
        h = range_hash(prefix_sums(data), start, start + length)
        parts = -(-start.size * length // bucket)
        part = (h % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            own = order[x:y]
            if own.size > 1:
                copy = data[start[own][:, None] + np.arange(length)].reshape(-1)
                _, cls = sort_suffixes(copy, np.arange(own.size) * length, length)
                flag[own] = np.bincount(cls, heavy[own])[cls] > 1
    return np.split(flag, np.cumsum(windows)[:-1])


def _sorter(length: int, bucket: int):
    """Streams context rows sorted by key and bytes; yields (blk, row, start, end) of repeated stretches.

    Of equal rows the first is held until a second comes; then all are put out at once and only
    the text stays, as heavy. So a key's distinct texts are held, whatever the number of rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []  # distinct texts of whole keys, that are sorted together
        weight: list[int] = []
        places: list[tuple | None] = []  # of texts of weight 1
        mates: list[bool] = []  # whether the key has another text
        out: tuple[list, list, list, list] = ([], [], [], [])
        key, begin, size = None, 0, 0

        def put(rows: tuple, ranges: list[tuple[int, int]]) -> None:
            blk, row, start = rows
            for u, v in ranges:
                out[0].extend([blk] * len(row))
                out[1].extend(row)
                out[2].extend([s + u for s in start])
                out[3].extend([s + v for s in start])

        def drain() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(out[0]), 1 << 16):
                cols = [o[at : at + (1 << 16)] for o in out]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["blk", "row", "start", "end"])
            for o in out:
                o.clear()

        def sort() -> None:
            nonlocal size
            own = [i for i, m in enumerate(mates) if m]
            if own:
                flags = _repeated([texts[i] for i in own], np.array([weight[i] for i in own]), length, bucket)
                for i, flag in zip(own, flags, strict=True):
                    if weight[i] == 1:
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.view(np.int8), [0]])))
                        put(places[i], [(int(u), int(v) - 1 + length) for u, v in zip(edge[::2], edge[1::2], strict=True)])
            for x in (texts, weight, places, mates):
                x.clear()
            size = 0

        for batch in batches:
            for k, text, blk, rows, starts in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                own = (blk, rows, starts)
                if k != key:
                    mates += [len(texts) - begin > 1] * (len(texts) - begin)
                    if size >= bucket:
                        sort()
                        yield from drain()
                    key, begin = k, len(texts)
                elif texts[-1] == text:
                    if weight[-1] == 1:
                        put(places[-1], [(0, len(text))])
                        places[-1] = None
                    weight[-1] += len(rows)
                    put(own, [(0, len(text))])
                    if len(out[0]) >= 1 << 18:
                        yield from drain()
                    continue
                texts.append(text)
                weight.append(len(rows))
                places.append(own if len(rows) == 1 else None)
                if len(rows) > 1:
                    put(own, [(0, len(text))])
                size += len(text)
        mates += [len(texts) - begin > 1] * (len(texts) - begin)
        sort()
        yield from drain()

    return scan


def _merge(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(start.tolist(), end.tolist(), strict=True)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk so that no character is cut in two."""
    out = []
    for s, e in spans:
        while s < e and text[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def remove_repeats(df: DataFrame, text_col: str = "text", length: int = LENGTH, characters: bool = False, bucket: int = BUCKET_BYTES, piece: int = PIECE_BYTES, hot: int = HOT) -> DataFrame:
    """df with columns kept, n_bytes, n_removed and n_spans added.

    kept is binary: the bytes that stay, concatenated. With characters=True a
    character of which only a part is covered stays whole, so that kept is UTF-8.
    """
    own = [c for c in df.columns if c not in (text_col, *RESULT)]
    store = Blocks(df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.col(f"`{text_col}`").isNull().alias("absent")), "repeats")
    place = (F.col("__blk").cast("long") * (1 << 33)) + F.col("__row")
    digests, _ = settle(store.df.select("__blk", "__row", F.md5("text").alias("digest"), F.octet_length("text").cast("long").alias("n")).where(F.col("n") >= length), "repeats-digests")
    copied = digests.groupBy("digest", "n").agg(F.count("*").alias("copies"), F.min(place).alias("first")).where("copies > 1").drop("copies")
    copies, _ = settle(digests.join(copied, ["digest", "n"]).select(F.col("__blk").alias("blk"), F.col("__row").alias("row"), "n", (place == F.col("first")).alias("first")), "repeats-copies")
    zero = F.lit(0).cast("long").alias("b")
    skip = copies.where("not first").select("blk", F.lit(1).alias("kind"), F.col("row").alias("a"), zero)
    anchors = store.over(store.every().union(skip), ["text"], _anchor_pass(length, piece), "h bigint, blk int, n bigint")
    total = F.sum("n").over(Window.partitionBy("h"))
    twice, _ = settle(anchors.withColumn("n", total).where("n > 1"), "repeats-anchors")
    wanted = twice.select("blk", F.when(F.col("n") > hot, 4).otherwise(2).alias("kind"), F.col("h").alias("a"), zero)
    if not wanted.where("kind = 4").isEmpty():
        shared = store.over(wanted.where("kind = 4").union(skip), ["text"], _fine_pass(length, piece, STEP), "h bigint, blk int, n bigint")
        wanted = wanted.union(shared.withColumn("n", total).where("n > 1").select("blk", F.lit(5).alias("kind"), F.col("h").alias("a"), zero))
    contexts = store.over(wanted.union(skip), ["text"], _context_pass(length, piece, STEP), "key bigint, bytes binary, blk int, rows array<bigint>, starts array<bigint>")
    spans = contexts.repartition("key").sortWithinPartitions("key", "bytes").mapInArrow(_sorter(length, bucket), "blk int, row bigint, start bigint, end bigint")
    # kind 3: a row, and a span as start * 2**31 + length
    told = spans.select("blk", F.lit(3).alias("kind"), F.col("row").alias("a"), (F.col("start") * (1 << 31) + (F.col("end") - F.col("start"))).alias("b"))
    whole = copies.select("blk", F.lit(3).alias("kind"), F.col("row").alias("a"), F.col("n").alias("b"))
    kinds = [store.df.schema[f"c{i}"].dataType.simpleString() for i in range(len(own))]
    schema = ", ".join([*(f"c{i} {k}" for i, k in enumerate(kinds)), "kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, absent boolean"])
    arrow = to_arrow_schema(store.df.select(*(f"c{i}" for i in range(len(own)))).schema)

    def cut(blk: int, told: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, span = told.get(3, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        order = np.argsort(row, kind="stable")
        row, span = row[order], span[order]
        for batch in batches:
            rows = batch.column(0).to_numpy()
            texts = batch.column(1).cast(pa.binary())
            size = _sizes(texts).astype(np.int64)
            removed, n_spans = np.zeros(rows.size, np.int64), np.zeros(rows.size, np.int64)
            x, y = np.searchsorted(row, rows, "left"), np.searchsorted(row, rows, "right")
            hit = np.flatnonzero(y > x)
            kept: pa.Array = texts
            if hit.size:
                new = {}
                for i in hit.tolist():
                    text = texts[i].as_py()
                    found = _merge(span[x[i] : y[i]] >> 31, (span[x[i] : y[i]] >> 31) + (span[x[i] : y[i]] & 0x7FFFFFFF))
                    if characters:
                        found = _whole_characters(text, found)
                    n_spans[i], removed[i] = len(found), sum(e - s for s, e in found)
                    edges = [0, *(p for s in found for p in s), len(text)]
                    new[i] = b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                kept = pa.array([new[i] if i in new else t.as_py() for i, t in enumerate(texts)], pa.binary())
            extra = [batch.column(k).cast(arrow.field(k - 3).type) for k in range(3, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*extra, kept, pa.array(size), pa.array(removed), pa.array(n_spans), batch.column(2)], [*(f"c{i}" for i in range(len(own))), "kept", "n_bytes", "n_removed", "n_spans", "absent"])

    columns = ["text", "absent", *(f"c{i}" for i in range(len(own)))]
    out = store.over(store.every().union(told).union(whole), columns, cut, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(own)), *RESULT)


def _sizes(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.binary_length(texts).to_numpy(zero_copy_only=False)


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
