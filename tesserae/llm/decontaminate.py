"""Test items inside documents, by size-partitioned MinHash containment search.

Items are partitioned by size (number of distinct five-word shingles, by powers of
two), and a document meets only partitions whose items it is long enough to hold. An item of n shingles is sketched by its n - ceil(t n) + 1 least hashes: a
document that holds a share t or more of them must hold one of these, so the search
misses nothing whatever the document's length, and the sketch of a short item stays
short. Documents whose shingles meet a sketch are compared exactly: first by all
shingle hashes of the item, then by the shingles themselves.

Words are maximal runs of ASCII letters, digits and non-ASCII characters of the
lower-cased text. An item of fewer than five words is one shingle of all its words.

Items are a stated query set: they are taken in blocks of a bounded number of hashes,
each block against all documents in one scan, so no text is shuffled or collected. Equal
items are searched once, under the digest of their text.

Edge cases: null or empty texts and items hold no words and give no rows; repeated
documents, and items of repeated ids, give a row each; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import read, settle, small_batches
from ._text import WORD, mix, prefix_sums, range_hash, runs, text_chunks

WORDS, SHARE = 5, 0.8
#: Shingle hashes of items held by a task at once (8 bytes each, and their texts).
BLOCK = 1 << 18
_STEP = np.uint64(0xD6E8FEB86659FD93)


def words(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    s, e = runs(WORD[data], np.array([0, data.size]))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]


def shingles(text: str | None, size: int = WORDS) -> set[bytes]:
    w = words(text)
    if not w:
        return set()
    n = min(size, len(w))
    return {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, from the words' hashes."""
    if h.size < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(h.size - n + 1, np.uint64)
    for k in range(n):
        out *= _STEP
        out += h[k : h.size - n + 1 + k]
    return mix(out)


def _word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e = runs(WORD[data], offs)
    return range_hash(prefix_sums(data), s, e), np.searchsorted(offs, s, "right") - 1


def sketch_size(n: int, share: float = SHARE) -> int:
    """Least hashes of n that must be looked up so that a share is never missed."""
    return n - math.ceil(round(share * n, 9)) + 1


class Items:
    """Items partitioned by size, with sketches and whole shingle sets."""

    def __init__(self, names: list, texts: list[str], share: float):
        self.share = share
        self.names, self.texts, self.sets, self.width = [], [], [], []
        sketch: dict[int, dict[int, tuple[list, list]]] = {}
        for name, text in zip(names, texts, strict=True):
            data = np.frombuffer(text.encode(), np.uint8)
            h, _ = _word_hashes(data, np.array([0, data.size]))
            if not h.size:
                continue
            n = min(WORDS, h.size)
            own = np.unique(_rolled(h, n))
            k = len(self.names)
            self.names.append(name)
            self.texts.append(text)
            self.sets.append(own)
            self.width.append(n)
            least = own[: sketch_size(own.size, share)]
            part = sketch.setdefault(n, {}).setdefault(int(own.size).bit_length(), ([], []))
            part[0].append(least)
            part[1].append(np.full(least.size, k))
        #: by words in a shingle: the partitions' sorted (hashes, items), and a filter of 20 bits for all
        self.parts: dict[int, tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]] = {}
        for n, sizes in sketch.items():
            quick, parts = np.zeros(1 << 20, bool), []
            for bits, (hs, ks) in sizes.items():
                h, k = np.concatenate(hs), np.concatenate(ks)
                order = np.argsort(h, kind="stable")
                # shingles that a document needs to hold the share of the partition's smallest items
                parts.append((math.ceil(round(share * (1 << bits - 1), 9)), h[order], k[order]))
                quick[(h >> np.uint64(44)).astype(np.int64)] = True
            self.parts[n] = (quick, parts)

    def search(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, item, shared shingles) of every document that holds the share of an item."""
        h, doc = _word_hashes(data, offs)
        for n, (quick, parts) in self.parts.items():
            rolled = _rolled(h, n)
            at = np.flatnonzero(quick[(rolled >> np.uint64(44)).astype(np.int64)])
            at = at[doc[at] == doc[at + n - 1]]
            if not at.size:
                continue
            found = []
            room = np.bincount(doc, minlength=offs.size)[doc[at]] - n + 1
            for need, hs, ks in parts:
                own = at[room >= need]
                x, y = np.searchsorted(hs, rolled[own], "left"), np.searchsorted(hs, rolled[own], "right")
                hit = y > x
                times = (y - x)[hit]
                where = np.repeat(x[hit], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                found.append(np.repeat(doc[own[hit]], times) * len(self.names) + ks[where])
            begin = np.searchsorted(doc, np.arange(offs.size))
            last, own = -1, np.zeros(0, np.uint64)
            for pair in np.unique(np.concatenate(found)).tolist():
                d, k = divmod(pair, len(self.names))
                if d != last:
                    last, own = d, np.unique(_rolled(h[begin[d] : begin[d + 1]], n))
                need = math.ceil(round(self.share * self.sets[k].size, 9))
                if np.isin(self.sets[k], own, assume_unique=True).sum() < need:
                    continue
                mine = shingles(data[offs[d] : offs[d + 1]].tobytes().decode(), n)
                shared = len(shingles(self.texts[k]) & mine)
                if shared >= need:
                    yield d, k, shared


def _lowered(items: DataFrame, text_col: str) -> F.Column:
    return F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def item_blocks(items: DataFrame, share: float, text_col: str, block: int) -> Iterator[Broadcast]:
    """The distinct items in blocks of a bounded size, each as a broadcast `Items`, named by digest."""
    spark = items.sparkSession
    small_batches(spark)
    asked, _ = settle(items.select(_lowered(items, text_col).alias("text")).distinct().select(F.md5("text").alias("item"), "text"), "items")
    total = asked.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(1, math.ceil(total / (block * 4)))
    for k in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        held = part.orderBy("item", "text").toArrow().to_pydict()
        yield spark.sparkContext.broadcast(Items(held["item"], held["text"], share))


def contained(docs: DataFrame, items: DataFrame, share: float = SHARE, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_col, item_col, n_shared, n_item, containment) where containment >= share."""
    doc_type = docs.schema[doc_col].dataType.simpleString()
    named = items.select(F.md5(_lowered(items, text_col)).alias("digest"), F.col(item_col).alias("item"))
    texts = docs.select(F.col(doc_col).alias("doc"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    out = None
    for held in item_blocks(items, share, text_col, block):

        def scan(batches: Iterator[pa.RecordBatch], held: Broadcast = held) -> Iterator[pa.RecordBatch]:
            known = held.value
            names = pa.array(known.names, pa.string())
            for batch in batches:
                rows = []
                for a, _, data, offs in text_chunks(batch, "text"):
                    rows += [(a + d, k, s, known.sets[k].size) for d, k, s in known.search(data, offs)]
                if rows:
                    d, i, s, n = (pa.array(c) for c in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(d), names.take(i), s.cast(pa.int64()), n.cast(pa.int64())], ["doc", "digest", "n_shared", "n_item"])

        found = texts.mapInArrow(scan, f"doc {doc_type}, digest string, n_shared bigint, n_item bigint")
        out = found if out is None else out.union(found)
    share_of = (F.col("n_shared") / F.col("n_item")).alias("containment")
    return out.join(named, "digest").select(F.col("doc").alias(doc_col), F.col("item").alias(item_col), "n_shared", "n_item", share_of)


def without_items(docs: DataFrame, items: DataFrame, share: float = SHARE, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """docs without those that hold the share of any item; judged in the scan, without a join."""
    out = docs.withColumn("__low", F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    for held in item_blocks(items, share, text_col, block):

        def scan(batches: Iterator[pa.RecordBatch], held: Broadcast = held) -> Iterator[pa.RecordBatch]:
            known = held.value
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for a, _, data, offs in text_chunks(batch, "__low"):
                    clean[[a + d for d, _, _ in known.search(data, offs)]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(scan, fields)
    return out.drop("__low")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+'), lambda x: x <> '')"

OP5_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_parts AS (SELECT item_id, least({WORDS}, len(w)) AS n, unnest(list_distinct(list_transform(range(1, len(w) - least({WORDS}, len(w)) + 2), lambda i: list_aggregate(w[i:i + least({WORDS}, len(w)) - 1], 'string_agg', ' ')))) AS s FROM items WHERE len(w) > 0),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
widths AS (SELECT DISTINCT n FROM item_parts),
doc_parts AS (SELECT doc_id, n, unnest(list_distinct(list_transform(range(1, len(w) - n + 2), lambda i: list_aggregate(w[i:i + n - 1], 'string_agg', ' ')))) AS s FROM docs, widths WHERE len(w) >= n),
sizes AS (SELECT item_id, count(*) AS n_item FROM item_parts GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item)::DOUBLE AS containment
FROM doc_parts JOIN item_parts USING (n, s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= {SHARE} * any_value(n_item)
"""
