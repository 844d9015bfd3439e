"""Packing, token files and sharding: exact round trips and laws."""

import pathlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tesserae.llm import _tokens, packing, reshard, tokenfiles
from tesserae.llm._tables import filesystem, shared_dir

SCHEMA = "doc_id long, text string"
ODD = [None, "", " ", "\n\n\n", "a" * 30000, "<|endoftext|> it's", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", " <|endoftext|>\n", "naïve café — 你好 🙂", "x\ty  z", "tab\t" * 500, "Plain words, twice. Plain words, twice."]


def library():
    return Tokenizer.from_file(_tokens.default_path())


def table(spark, n=80):
    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(rng.choice(["alpha", "Beta", "gamma,", "12", "δ"]) for _ in range(rng.randrange(0, 900)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_ids_equal_the_library():
    lib = library()
    for t in ODD:
        assert _tokens.ids(t, _tokens.default_path()).tolist() == lib.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("run", [" " * 1_000_000, "\t" * 3_000_000, "\n " * 40_000, "\u3000\xa0" * 40_000, "\x1c" * 70_000, " " * (_tokens.RUN - 1), " " * _tokens.RUN])
def test_ids_of_long_runs_equal_the_library(run):
    lib = Tokenizer.from_file(_tokens.default_path())
    for t in (run, run + "a", f"it's{run}?{run}\u4f60", f"1{run} b  c"):
        assert np.array_equal(_tokens.ids(t, _tokens.default_path()), lib.encode(t, add_special_tokens=False).ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 7000), max_size=60), st.booleans())
def test_pack_places_every_token_once(lengths, last):
    full, rest = packing.pack(lengths, last=last)
    seen = defaultdict(list)
    for size, window in full:
        assert sum(n for _, _, n in window) == size and size & (size - 1) == 0
        for d, s, n in window:
            seen[d].append((s, n))
    for d, s, n in rest:
        seen[d].append((s, n))
    assert not (last and rest)
    for d, n in enumerate(lengths):
        at = 0
        for s, k in sorted(seen[d]):
            assert s == at
            at += k
        assert at == n


@pytest.mark.parametrize("lengths", [[1] * 100, [1] * 1000, [2, 1, 3] * 333, [300, *[1] * 200]])
@pytest.mark.parametrize("last", [False, True])
def test_pack_many_tiny_pieces(lengths, last):
    full, rest = packing.pack(lengths, last=last)
    assert all(sum(n for _, _, n in w) == size for size, w in full)
    assert sum(size for size, _ in full) + sum(n for _, _, n in rest) == sum(lengths)
    assert sum(n for _, _, n in rest) == 0 if last else sum(n for _, _, n in rest) < packing.TIERS[-1]


def test_packed_table_of_empty_texts(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "") for i in range(600)], SCHEMA).coalesce(1)
    got = packing.digest(packing.pack_documents(df)).toPandas()
    assert sorted(got.doc_id) == list(range(600)) and (got.length == 1).all()


def test_steps_are_balanced():
    rng = random.Random(0)
    seqs = [(2048, [(0, 0, n), (1, 0, 2048 - n)]) for n in (rng.randrange(1, 2048) for _ in range(64))]
    group = packing.steps(seqs)
    load = defaultdict(list)
    for (_, w), g in zip(seqs, group, strict=True):
        load[g].append(sum(n * n for _, _, n in w))
    assert {len(v) for v in load.values()} == {16}
    assert max(map(sum, load.values())) < 1.1 * min(map(sum, load.values()))


def test_packed_table(spark):
    rows, df = table(spark)
    lib = library()
    ids = {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    for pool in (packing.POOL, 3000):
        got = packing.digest(packing.pack_documents(df, pool=pool)).toPandas()
        for i, g in got.groupby("doc_id"):
            g = g.sort_values("start")
            assert g.start.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() == ids[i].size == g.doc_tokens.iloc[0]
            assert all(zlib.crc32(ids[i][s : s + n].tobytes()) == c for s, n, c in zip(g.start, g.length, g.ids_crc32, strict=True))
        assert set(got.doc_id) == set(ids)
        for _, g in got.groupby("sequence_id"):
            g = g.sort_values("offset")
            assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048


def test_token_files(spark, tmp_path):
    rows, df = table(spark)
    df = df.withColumnRenamed("doc_id", "n_tokens").union(spark.createDataFrame([(None, "none")], SCHEMA))
    folder = shared_dir(spark, "tokens-test")
    ranges = tokenfiles.write_tokens(df, folder, id_col="n_tokens", length=64, rows=4)
    lib = library()
    at = 0
    got = {r[0]: r for r in tokenfiles.read_tokens(ranges, folder, "name", "bigint").collect()}
    for i, t in [(None, "none"), *sorted(rows)]:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(got[i]) == (i, at, ids.size, zlib.crc32(ids.tobytes()))
        at += ids.size
    fs, root = filesystem(folder)
    k = ranges.orderBy("range").first()["range"]
    with pa.memory_map(f"{root}/ids-{k:06d}.arrows") as source:
        held = tokenfiles.SequenceFile(source)
        ids, mask = held.sequence(0)
        assert ids.size == 64 and ids.dtype == np.uint16 and not ids.flags.owndata and len(mask) == 64
        assert held.batch(0).column("ids").type == pa.list_(pa.uint16(), 64)
        total = sum(b.column("mask").values.to_numpy(zero_copy_only=False).sum() for b in held.batches)
        assert total == ranges.orderBy("range").first()["ids"]
    empty = tokenfiles.write_tokens(df.where("false"), shared_dir(spark, "none"), id_col="n_tokens")
    assert empty.collect() == []


def test_equal_and_missing_ids_are_split(spark):
    rows = [(None if i % 2 else 7, f"text {i % 300}") for i in range(900)]
    folder = shared_dir(spark, "tokens-ties")
    ranges = tokenfiles.write_tokens(spark.createDataFrame(rows, SCHEMA), folder, range_bytes=1000, length=16, rows=2)
    assert ranges.count() > 4 and max(r.documents for r in ranges.collect()) < 400
    got = tokenfiles.read_tokens(ranges, folder, "doc_id", "bigint").toPandas().sort_values("start")
    assert got.start.tolist() == [0, *got.n_tokens.cumsum().tolist()[:-1]] and got.doc_id.isna().tolist() == [True] * 450 + [False] * 450
    lib = library()
    assert sorted(got.ids_crc32) == sorted(zlib.crc32(np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for _, t in rows)


@pytest.mark.parametrize("sizes", [[], [5], [16] * 8, [40, 0, 3, 200]])
def test_sequence_file_reads_by_offset(tmp_path, sizes):
    rng, path = np.random.default_rng(0), str(tmp_path / "f.arrows")
    ids = [rng.integers(0, 50257, n).astype(np.uint32) for n in sizes]
    with pa.OSFile(path, "wb") as sink:
        out = tokenfiles.SequenceWriter(sink, 50257, 16, 2)
        for x in ids:
            out.add(x)
        out.close()
    for source in (pa.memory_map(path), pa.OSFile(path)):
        held, at = tokenfiles.SequenceFile(source), 0
        assert held.count == -(-sum(sizes) // 32)
        for x in ids:
            assert np.array_equal(held.ids(at, x.size), x)
            at += x.size


def test_flow_is_least_and_feasible():
    rng = random.Random(4)
    for _ in range(20):
        n, m = rng.randrange(1, 6), rng.randrange(1, 8)
        supply = [rng.randrange(0, 50) for _ in range(n)]
        capacity = [-(-sum(supply) // m)] * m
        flow = reshard.min_cost_flow(supply, capacity)
        assert all(sum(x for (i, _), x in flow.items() if i == k) == s for k, s in enumerate(supply))
        assert all(sum(x for (_, j), x in flow.items() if j == k) <= c for k, c in enumerate(capacity))
        stay = sum(x for (i, j), x in flow.items() if i == j)
        assert stay == sum(min(s, capacity[k]) for k, s in enumerate(supply) if k < m)


@pytest.mark.parametrize("hot", [False, True])
def test_shards(spark, tmp_path, hot):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcdé ") for _ in range(rng.randrange(0, 2500)))) for i in range(1200)] + [(1500, None), (1501, ""), (None, "z")]
    rows += [(2000 + i, "copy " * 40) for i in range(300 if hot else 3)] + [(5000, "twice"), (5000, "twice")]
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard int").write.parquet(str(tmp_path / "documents.parquet"))
    got = reshard.op3_reshard(spark, str(tmp_path)).toPandas()
    assert len(got) == len(rows) and (got.law == "bytes").all() and got.grown_shard.isna().all()
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 40 and load.max() <= 1.1 * load.mean() and load.min() >= 0.9 * load.mean()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    by = {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows}
    assert all(by[None if np.isnan(d) else int(d)] == (s, c) for d, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True))
    if not hot:
        assert got[got.doc_id.between(2000, 4999)].shard.nunique() == 1


def test_blocks_move_little_more_than_the_flow():
    rng = random.Random(3)
    for old, new in ((32, 40), (40, 32), (8, 8), (5, 17)):
        blocks = {b: (b % old, int(rng.lognormvariate(12, 0.7))) for b in range(old * 128)}
        files = {b: (b % old) * 8 + b // old % 8 for b in blocks}
        chosen = reshard.assign(blocks, [1] * new, files)
        total = sum(x for _, x in blocks.values())
        supply = [sum(x for o, x in blocks.values() if o == i) for i in range(old)]
        least = sum(x for (i, j), x in reshard.min_cost_flow(supply, [-(-total // new)] * new).items() if i != j)
        moved = sum(x for b, (o, x) in blocks.items() if chosen[b] != o)
        load = [sum(x for b, (_, x) in blocks.items() if chosen[b] == j) for j in range(new)]
        assert least <= moved + new and moved <= 1.01 * least + 0.001 * total, (old, new, moved, least)
        assert max(load) < 1.01 * total / new and min(load) > 0.99 * total / new
        if new >= old > 5:
            assert len({files[b] for b, j in chosen.items() if j != b % old}) <= 3 * old


def test_only_files_that_lose_blocks_are_rewritten(spark):
    rows = [(i, f"{i} " * (i % 300)) for i in range(3000)]
    old = reshard.write_shards(spark.createDataFrame(rows, SCHEMA), shared_dir(spark, "old-test"), 8, goal=10)
    before = {f: pathlib.Path(f.removeprefix("file:")).stat().st_mtime_ns for f in spark.read.parquet(old.folder).inputFiles()}
    new = shared_dir(spark, "new-test")
    out = reshard.reshard(spark, old, new, [1] * 10)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 3000 and all(got[i].text == t for i, t in rows)
    assert all(r.moved == (r.shard != r.old_shard) for r in got.values())
    for j in range(10):
        assert sorted(r.slot for r in got.values() if r.shard == j) == list(range(sum(r.shard == j for r in got.values())))
    used = set(out.inputFiles())
    kept = {f for f in used if f in before}
    assert 0.5 * len(before) < len(kept) < len(before)
    assert all(pathlib.Path(f.removeprefix("file:")).stat().st_mtime_ns == before[f] for f in before)


def test_empty_table_has_no_shards(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert reshard.op3_reshard(spark, str(tmp_path)).collect() == []
