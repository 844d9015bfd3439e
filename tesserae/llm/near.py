"""Near copies by exact Jaccard similarity of word shingles.

Sets of hashed shingles are joined by prefix filtering (see _setjoin), which loses no pair.
The order of members puts shingles that were seen often last, so repeated lines bring few
sets together; how often is counted in pieces of PIECE shingles, and only the OFTEN commonest
are told apart. Members are 64-bit hashes.

Edge cases: null or blank text is the set of the empty shingle, fewer words than a
shingle has are one shingle; an empty table gives none; repeated rows are one group;
a null id comes last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import ROW_BITS, Blocks
from ._setjoin import like_sets, prefix_bound, shared_entries
from ._tables import lean
from ._text import LOWER, SPACE, mix, prefix_sums, range_hash, runs, text_chunks
from .simhash import first_places

SIMILARITY, SHINGLE = 0.8, 5
#: Shingles counted at a time, and common shingles that the order knows.
PIECE, OFTEN = 1 << 21, 1 << 17
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _rolled(words: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(words.size - n + 1, np.uint64)
    for k in range(n):
        out *= _STEP
        out += words[k : words.size - n + 1 + k]
    return mix(out)


def shingles(data: np.ndarray, offs: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's lower-cased word shingles."""
    low = LOWER[data]
    s, e = runs(~SPACE[low], offs)
    words = range_hash(prefix_sums(low), s, e)
    cut = np.searchsorted(s, offs)
    every = _rolled(words, shingle).view(np.int64) if words.size >= shingle else np.zeros(0, np.int64)
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(every[a : b - shingle + 1]))
        else:
            out.append(_rolled(words[a:b], b - a).view(np.int64) if b > a else np.zeros(1, np.int64))
    return out


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, shingles) of the rows of batches of a place and a text."""
    for batch in batches:
        for a, b, data, offs in text_chunks(batch, batch.schema.names[1]):
            yield from zip(batch.column(0)[a:b].to_pylist(), shingles(data, offs, shingle), strict=True)


def common(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are seen more than once in a piece, sorted, and their counts; OFTEN at most."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1]), pa.array(n[n > 1])], ["h", "n"])

        held, size = [], 0
        for _, own in _sets(batches, shingle):
            held.append(own)
            size += own.size
            if size >= PIECE:
                yield told()
                held, size = [], 0
        if held:
            yield told()

    top = rows.mapInArrow(lean(scan), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(OFTEN).toPandas()
    h, n = top["h"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def prefixes(rows: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(h, pos, n, node): the rarest shingles of every row of place and text, as many as similar sets must share one of."""
    known = rows.sparkSession.sparkContext.broadcast(common(rows, shingle))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, count = known.value
        cols: list[list] = [[], [], [], []]
        held = 0
        for place, s in _sets(batches, shingle):
            seen = np.zeros(s.size, np.int64)
            if often.size:
                at = np.minimum(np.searchsorted(often, s), often.size - 1)
                seen = np.where(often[at] == s, count[at], 0)
            first = s[np.lexsort((s, seen))][: prefix_bound(s.size, similarity)]
            held += first.size
            for c, v in zip(cols, (first, np.arange(first.size, dtype=np.int32), np.full(first.size, s.size, np.int32), np.full(first.size, place, np.int64)), strict=True):
                c.append(v)
            if held >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["h", "pos", "n", "node"])
                cols, held = [[], [], [], []], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["h", "pos", "n", "node"])

    return rows.mapInArrow(lean(scan), "h bigint, pos int, n int, node bigint")


def like_places(store: Blocks, text_at: str, rows: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(node, root): places of a store, of those of rows (place, text), whose texts have a like one."""

    def sets(blk: int, told: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.sort(told[1][0])
        for batch in batches:
            part = batch.filter(pa.array(np.isin(batch.column(0).to_numpy(), wanted, assume_unique=True)))
            for at, s in _sets(iter([part]), shingle):
                yield pa.RecordBatch.from_arrays([pa.array([(blk << ROW_BITS) + at], pa.int64()), pa.array([s], pa.list_(pa.int64()))], ["node", "s"])

    def sets_of(nodes: DataFrame) -> DataFrame:
        return store.over(store.told(nodes, "node"), [text_at], sets, "node bigint, s array<bigint>")

    return like_sets(shared_entries(prefixes(rows, similarity, shingle), "near"), sets_of, similarity, "near")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, radius: int | None = None) -> DataFrame:
    """df with one row of each group of near copies: the one of smallest id (of repeated ids, one row).

    With a radius, only the first of each SimHash group of three-word shingles takes part, so that
    closest copies have gone before. Texts are written to a block store once and chosen there.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    store = Blocks(df.toDF(*names), "near-rows")
    id_at, text_at = (names[df.columns.index(c)] for c in (id_col, text_col))
    key = F.struct(F.col(id_at).isNull().alias("none"), F.col(id_at).alias("id"), store.place.alias("place"))
    left = store.df.select(store.place.alias("place")) if radius is None else first_places(store, id_at, text_at, radius)
    rows = store.df.select(store.place.alias("place"), text_at) if radius is None else store.chosen(left, "place", [text_at])
    roots = like_places(store, text_at, rows, similarity, shingle)
    named = roots.join(store.df.select(store.place.alias("node"), key.alias("key")), "node")
    first = named.groupBy("root").agg(F.min("key").alias("first")).select(F.col("first.place").alias("place"))
    gone = roots.select(F.col("node").alias("place")).join(first, "place", "left_anti")
    return store.chosen(left.join(gone, "place", "left_anti"), "place", names, False).toDF(*df.columns)
