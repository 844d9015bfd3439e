"""SimHash near-duplicate groups by exact tiled comparison of 64-bit fingerprints.

Fingerprints at most three bits apart agree on one of four 16-bit blocks, so the
exact comparison runs within blocks of equal value. Inside a block rows are dealt
into tiles by population count; a tile meets only tiles whose counts differ by no
more than the radius, because differing counts bound the distance from below.
Tiles are compared by numpy exclusive-or and bit counts.

Edge cases: null or blank text has fingerprint zero and links to other such
texts; equal texts share a fingerprint and a group; a table without rows gives
none; a null doc_id is passed through and is never a group's name unless alone.
Columns besides the two named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import Blocks
from ._components import components, forest
from ._tables import lean, read, settle, small_batches

RADIUS, SHINGLE, SEED, BLOCKS = 3, 3, 42, 4
#: Home rows that one tile holds at most; larger tiles are split, and every piece meets every other.
TILE_ROWS = 8192
_SLICE = 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED, piece: int = 1 << 21) -> int:
    """Unsigned 64-bit SimHash of a text's lower-cased word shingles."""
    digest = xxhash.xxh64_digest
    total, count, held, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(data):
        # a long text is taken in slices that end at white space; the last words lead the next
        end = at + piece
        if end < len(data):
            end = found.start() if (found := _SPACE.search(data, end)) else len(data)
        held += data[at:end].lower().split()
        at = end
        if len(held) < shingle:
            continue
        grams = map(b" ".join, zip(*(held[i:] for i in range(shingle)), strict=False))
        raw = np.frombuffer(b"".join([digest(g, seed) for g in grams]), np.uint8).reshape(-1, 8)
        for i in range(0, len(raw), _SLICE):
            total += np.unpackbits(raw[i : i + _SLICE], axis=1).sum(axis=0, dtype=np.int32)
        count += len(raw)
        held = held[len(held) - shingle + 1 :]
    if not count:
        return int.from_bytes(digest(b" ".join(held), seed), "big") if held else 0
    return int.from_bytes(np.packbits(total * 2 > count).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id_col, fp): the fingerprint of each row as a signed long."""

    small_batches(df.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                fp = np.array([fingerprint(t or b"", shingle, seed) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], [id_col, "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(lean(scan), f"`{id_col}` {kind}, fp bigint")


def _tile(a: np.ndarray, b: np.ndarray | None, radius: int, side: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within a (b None) or between a and b, one tile pair at a time, as spanning forests."""
    other = a if b is None else b
    for x in range(0, a.size, side):
        for y in range(x if b is None else 0, other.size, side):
            p, q = a[x : x + side], other[y : y + side]
            i, j = np.nonzero(np.bitwise_count(p[:, None] ^ q[None, :]) <= radius)
            if b is None and x == y:
                i, j = i[i < j], j[i < j]
            if i.size > 2 * (p.size + q.size):
                rows = np.concatenate([p, q])
                i, j = forest(i, j + p.size, rows.size)
                yield rows[i], rows[j]
            elif i.size:
                yield p[i], q[j]


def _linker(radius: int):
    """Streams rows sorted by tile (home rows first) and yields the links of each tile."""

    def out(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a = np.concatenate([p[0] for p in pairs]).view(np.int64)
        b = np.concatenate([p[1] for p in pairs]).view(np.int64)
        keep = a != b
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: tuple | None = None  # tile and home rows of the group that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = batch.column(0).to_numpy()
            visit = batch.column(1).to_numpy()
            fp = batch.column(2).to_numpy().view(np.uint64)
            pairs: list[tuple[np.ndarray, np.ndarray]] = []
            if tail is not None and tail[0] == tile[0]:
                n = int(np.searchsorted(tile, tile[0], "right")) if tile[0] != tile[-1] else tile.size
                new, guests = fp[:n][visit[:n] == 0], fp[:n][visit[:n] == 1]
                pairs += [*_tile(tail[1], new, radius)] if new.size else []
                home = np.concatenate([tail[1], new])
                pairs += [*_tile(new, None, radius)] if new.size > 1 else []
                pairs += [*_tile(home, guests, radius)] if guests.size else []
                tail = (tile[0], home)
                tile, visit, fp = tile[n:], visit[n:], fp[n:]
            if tile.size:
                start = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
                count = np.diff(np.append(start, tile.size))
                small = np.repeat(count <= 16, count)
                for s in range(1, min(16, int(count.max()))):
                    at = np.flatnonzero((tile[s:] == tile[:-s]) & small[s:] & (visit[:-s] == 0))
                    at = at[np.bitwise_count(fp[at] ^ fp[at + s]) <= radius]
                    if at.size:
                        pairs.append((fp[at], fp[at + s]))
                for g in np.flatnonzero(count > 16):
                    own = slice(start[g], start[g] + count[g])
                    home, guests = fp[own][visit[own] == 0], fp[own][visit[own] == 1]
                    pairs += _tile(home, None, radius)
                    if guests.size:
                        pairs += _tile(home, guests, radius)
                last = slice(start[-1], tile.size)
                tail = (tile[-1], fp[last][visit[last] == 0])
            if pairs:
                yield out(pairs)

    return scan


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): links that connect exactly the distinct fingerprints (column fp) within the radius."""
    if radius >= blocks or 64 % blocks:
        raise ValueError("blocks must divide 64 and exceed the radius")
    width = 64 // blocks
    mask = (1 << width) - 1
    block = F.explode(F.array(*[F.shiftrightunsigned("fp", width * k).bitwiseAND(F.lit(mask)) * blocks + k for k in range(blocks)]))
    rows = distinct.select("fp", F.bit_count("fp").cast("long").alias("pop"), block.alias("block"))
    rows = rows.select("fp", "pop", (F.col("block") * 128).alias("block"))
    large = rows.groupBy((F.col("block") + F.col("pop")).alias("tile")).count().where(F.col("count") > tile_rows)
    large = large.select("tile", F.ceil(F.col("count") / tile_rows).cast("int").alias("pieces"))
    meets = F.explode(F.sequence(F.lit(0), F.lit(radius)))
    dealt = rows.select("fp", "block", "pop", meets.alias("d")).select("fp", (F.col("block") + F.col("pop") + F.col("d")).alias("tile"), F.col("d"))
    dealt = dealt.join(large, "tile", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    dealt = dealt.select("fp", "tile", "d", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    # a piece's own rows are at home there; rows of earlier pieces and lower counts visit
    dealt = dealt.where((F.col("d") > 0) | (F.col("own") <= F.col("piece")))
    visit = ((F.col("d") > 0) | (F.col("own") < F.col("piece"))).cast("int")
    dealt = dealt.select(F.xxhash64("tile", "piece").alias("tile"), visit.alias("visit"), "fp")
    dealt = dealt.repartition("tile").sortWithinPartitions("tile", "visit")
    return dealt.mapInArrow(_linker(radius), "a bigint, b bigint").distinct()


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(id_col, fp, component_id): component_id is the smallest id reachable over links."""
    fps, _ = settle(fingerprints(df, id_col, text_col, shingle), "simhash")
    nodes = fps.groupBy("fp").agg(F.min(id_col).alias("first"))
    roots = components(links(nodes, radius), "simhash-links")
    least = roots.join(nodes, roots.node == nodes.fp).groupBy("root").agg(F.min("first").alias("component_id"))
    linked = roots.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    named = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return fps.join(named, "fp").select(id_col, "fp", "component_id")


def first_places(store: Blocks, id_at: str, text_at: str, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(place) of one row of each group of a store: the one of smallest id (of repeated ids, one row)."""
    # a null id comes last, so that it names a group of its own kind only
    key = F.struct(F.col(id_at).isNull().alias("none"), F.col(id_at).alias("id"), store.place.alias("place")).alias("key")
    found = groups(store.df.select(key, F.col(text_at).alias("text")), "key", "text", radius, shingle)
    return settle(found.select(F.col("component_id.place").alias("place")).distinct(), "simhash-first")[0]


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """df with one row of each group: the one of smallest id (of repeated ids, one row).

    Rows are kept in a block store and chosen there, so texts are not shuffled.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    store = Blocks(df.toDF(*names), "simhash-rows")
    id_at, text_at = (names[df.columns.index(c)] for c in (id_col, text_col))
    return store.chosen(first_places(store, id_at, text_at, radius, shingle), "place", names, False).toDF(*df.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
