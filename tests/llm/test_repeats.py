"""Exact repeat removal and its suffix sorter against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import repeats
from tesserae.llm.suffixes import COVER, PERIOD, sort_suffixes

SCHEMA = "doc_id long, text string"


def brute(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), spans, kept))
    return out


def test_cover_is_a_difference_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize("trial", range(8))
def test_suffixes_are_sorted(trial):
    rng = np.random.default_rng(trial)
    base = rng.integers(97, 99 + trial, 400).astype(np.uint8)
    parts = [base[rng.integers(0, 100) : rng.integers(300, 400)].copy() for _ in range(12)]
    for p in parts[::2]:
        p[rng.integers(0, p.size)] = 120
    text = np.concatenate(parts)
    start = np.arange(text.size - 200)
    order, cls = sort_suffixes(text, start)
    raw = text.tobytes()
    strings = [raw[s : s + 200] for s in start]
    assert [strings[i] for i in order] == sorted(strings)
    rank = {s: k for k, s in enumerate(sorted(set(strings)))}
    assert cls.tolist() == [rank[s] for s in strings]


def make_texts():
    rng = np.random.default_rng(5)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage, other = word(260), "é" * 150 + word(120)
    texts = [word(300) + passage + word(100), passage + word(50), word(199), word(200), "x" * 700, "ab" * 300, None, "", word(80) + other + word(90), other, other + word(10), word(400)]
    copy = word(500)
    texts += [copy, copy, copy[:260] + "!" + copy[261:], word(30) + passage[:199] + word(30), passage[5:205]]
    for k in range(30):
        p = list(copy)
        p[int(rng.integers(0, 500))] = "#"
        texts.append("".join(p) + str(k))
    return texts


def test_against_brute_force(spark):
    texts = make_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(docs).collect()}
    for i, want in enumerate(brute(texts)):
        assert got[i] == want, i


def test_buckets_and_pieces_of_any_size_agree(spark):
    texts = make_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(2)
    for bucket, hot in ((1000, repeats.HOT), (20000, 1), (1000, 4)):
        got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(docs, bucket=bucket, piece=bucket // 3, hot=hot).collect()}
        assert got == {i: w[1] for i, w in enumerate(brute(texts))}


def test_a_line_of_very_many_texts(spark):
    """A shared line of 180 bytes in 20000 contexts, some of which repeat: no task gets the line's contexts."""
    line = "".join(map(chr, np.random.default_rng(1).integers(97, 123, 180)))
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 512), F.lit(line), F.sha2((F.col("id") % 19990).cast("string"), 512)).alias("text")).repartition(6)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.remove_repeats(docs).select("doc_id", "n_removed", "n_spans").collect()}
    # ten pairs share the line and what follows it
    again = {*range(10), *range(19990, 20000)}
    assert len(got) == 20000 and all(got[i][0] >= 308 if i in again else got[i] == (0, 0) for i in got)


def test_whole_characters(spark):
    texts = ["é" * 200, "x" + "é" * 199 + "è", "é" * 120 + "ü" * 120, "plain"]
    out = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), SCHEMA), characters=True).collect()
    for r in out:
        bytes(r.kept).decode()


def test_empty_nulls_and_clashing_columns(spark):
    empty = repeats.remove_repeats(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == []
    rows = [(None, None, 1, "a"), (None, "t" * 250, 2, "b"), (3, "t" * 250, 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, h string")
    got = sorted((r.h or "", r.n_bytes, r.n_removed) for r in repeats.remove_repeats(df).collect())
    assert got == [("", 250, 250), ("a", 0, 0), ("b", 250, 250)]


def test_query_digest(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one"), (2, None)], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.kept_sha256 for r in repeats.op1_repeats(spark, str(tmp_path)).collect()}
    assert got == {1: hashlib.sha256(b"one").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
