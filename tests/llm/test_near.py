"""SimHash groups, SpotSigs and containment against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import xxhash

from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import _components, _setjoin, _tables, decontaminate, near, simhash, spotsigs
from tesserae.llm._tables import settle

SCHEMA = "doc_id long, text string"
WORDS = "the of and to harbor window yellow quiet measure barrel orchard signal velvet copper lantern meadow".split()


def sentences(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprint():
    for t in ["", None, "One", "One two", "A b\tC\n d É Ü", sentences(1, 500)]:
        for piece in (1 << 21, 50, 1):
            assert simhash.fingerprint((t or "").encode(), piece=piece) == slow_fingerprint(t)


def test_links_connect_what_brute_force_links(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set()
    for b in base.tolist():
        for _ in range(20):
            x = b
            for _ in range(int(rng.integers(0, 5))):
                x ^= 1 << int(rng.integers(0, 64))
            fps.add(x)
    fps = sorted(fps)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 3:
            root[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    for tile_rows in (8192, 7):
        got = {x: x for x in fps}

        def seek(x, got=got):
            while got[x] != x:
                x = got[x]
            return x

        for r in simhash.links(df, tile_rows=tile_rows).collect():
            a, b = (int(np.int64(v).view(np.uint64)) for v in (r.a, r.b))
            assert (a ^ b).bit_count() <= 3 or tile_rows  # forests may link through others
            a, b = seek(a), seek(b)
            got[max(a, b)] = min(a, b)
        assert {x: seek(x) for x in fps} == {x: find(x) for x in fps}


def test_groups_and_kept_rows(spark):
    t = sentences(4, 300)
    rows = [(9, t), (4, t), (7, t + " end"), (5, None), (2, "  "), (8, ""), (None, sentences(5, 50)), (6, sentences(6, 50)), (6, sentences(6, 50))]
    df = spark.createDataFrame([(i, x, "k") for i, x in rows], "doc_id long, text string, fp string")
    got = simhash.groups(df.select("doc_id", "text")).collect()
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[9] == comp[4] == 4 and comp[5] == comp[2] == comp[8] == 2 and comp[6] == 6 and comp[None] is None
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert (False, 4) in ids and (False, 9) not in ids and ids.count((False, 6)) == 1 and (True, 0) in ids and ids.count((False, 2)) == 1
    assert simhash.groups(df.where("false").select("doc_id", "text")).collect() == [] == simhash.keep_first(df.where("false")).collect()


def slow_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def edited_copies():
    """Texts with copies of some edited words, a line that many share, and odd rows."""
    rng, line = random.Random(8), sentences(70, 12)
    out = {}
    for k in range(25):
        words = [f"{w}{rng.randrange(9)}" for w in sentences(100 + k, 150).split()]
        for c in range(4):
            new = list(words)
            for at in rng.sample(range(150), c * 2):
                new[at] = "edited"
            out[10 * k + c] = " ".join(new) + " " + line
    return out | {900: None, 901: "", 902: "one two", 903: "One  two", 904: "one three"}


def slow_kept(texts):
    sets = {i: slow_shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(texts, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {find(i) for i in texts}


def test_near_copies_are_those_of_brute_force(spark):
    texts = edited_copies()
    df = spark.createDataFrame(list(texts.items()), SCHEMA).repartition(3)
    kept = [r.doc_id for r in near.keep_first(df).collect()]
    assert sorted(kept) == sorted(slow_kept(texts)) and 0 < len(kept) < len(texts) - 25
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, "c")], SCHEMA)
    assert sorted((r.doc_id or 0, r.text) for r in near.keep_first(twice).collect()) == [(0, "c"), (1, "a b")]
    assert near.keep_first(df.where("false")).collect() == []


def test_pipeline_stage_leaves_no_near_copies(spark):
    texts = edited_copies()
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r.text for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()}
    assert slow_kept(kept) == set(kept) and {10 * k for k in range(25)} <= set(kept)


def slow_spots(text):
    w = re.findall(r"[^\W\d_]+", (text or "").lower())
    stop = set(spotsigs.ANCHORS)
    content = [i for i, x in enumerate(w) if x not in stop]
    spots = set()
    for i, j in itertools.pairwise(content):
        k = i - 1
        while k >= 0 and w[k] in stop:
            spots.add((w[k], w[i], w[j]))
            k -= 1
    return spots


def test_spots_are_anchored_chains(spark):
    texts = [sentences(k, 60) + " lantern" for k in range(6)] + [sentences(k, k) for k in range(12)] + ["of the and " * 20 + "copper velvet", "the copper", "The, copper! velvet of the", "copper velvet"]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r.doc_id: len(r.signatures) for r in spotsigs.signatures(df).collect()}
    assert got == {i: max(1, len(slow_spots(t))) for i, t in enumerate(texts)}


def slow_likeness(a, b):
    x, y = (slow_spots(t) or {t or ""} for t in (a, b))
    return len(x & y) / len(x | y)


def test_next_document_and_edit(spark, tmp_path):
    base = sentences(500, 200)
    rows = [(i * 3, sentences(i, i * 2)) for i in range(1, 90)] + [(None, "null id"), (300, None), (301, ""), (10**15, base), (-(10**15), base + " velvet copper"), (10**15 + 9, base)]
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, signatures int").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in spotsigs.op2_spotsigs(spark, str(tmp_path)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        t, n = t or "", n or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + n[:third]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[i].near_edited - slow_likeness(t, edited)) < 1e-9 and abs(got[i].near_next - slow_likeness(t, n)) < 1e-9
        if t == edited:
            assert got[i].near_edited == 1 and got[i].fingerprint == got[i].edited_fingerprint
    assert {got[i].near_group for i in (10**15, -(10**15), 10**15 + 9)} == {-(10**15)} and got[301].near_group == got[300].near_group == 300


def test_next_of_tied_and_missing_ids(spark):
    rows = [(None if i % 2 else 7, f"text {i}") for i in range(400)] + [(9, "first"), (3, "third")]
    got = spotsigs.with_next(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    assert {(r.doc_id, r.text, r.next) for r in got} == {(*a, b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True)} and len(got) == len(rows)


def test_near_groups_against_all_pairs(spark):
    texts = []
    for k in range(12):
        t = sentences(k, 80)
        texts += [t, t + " copper", t[: len(t) * 3 // 4], t + " copper"]
    texts += [None, "", "copper", "of the copper"] + [f"the common start of it {'and velvet copper ' * 3} {sentences(900 + k, 12)}" for k in range(15)]
    sets = spotsigs.signatures(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).withColumn("node", F.col("doc_id") + 5)
    sets, _ = settle(sets, "test-sets")
    held = {r.doc_id: frozenset(r.signatures) for r in sets.collect()}
    for similarity in (0.7, 0.8, 0.3):
        root = {i: i for i in held}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in itertools.combinations(held, 2):
            if len(held[a] & held[b]) >= similarity * len(held[a] | held[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
        want = {i: find(i) for i in held}
        for often in (1000, 3):
            got = {r.node - 5: r.near_group for r in spotsigs.near_groups(sets, similarity, often=often).collect()}
            assert got == {i: r for i, r in want.items() if list(want.values()).count(r) > 1} and got


def test_pieces_of_frequent_members_meet(spark, monkeypatch):
    rng = random.Random(5)
    sets = {i: sorted({rng.randrange(12) for _ in range(rng.randrange(1, 7))}) for i in range(120)}
    df, _ = settle(spark.createDataFrame(list(sets.items()), "node long, s array<long>"), "test-sets")
    entries = df.select("node", F.size("s").alias("n"), F.posexplode("s").alias("pos", "h")).select("h", "pos", "n", "node")
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if len({*sets[a]} & {*sets[b]}) >= 0.5 * len({*sets[a], *sets[b]}):
            root[max(find(a), find(b))] = min(find(a), find(b))
    live = _setjoin.shared_entries(entries, "test")
    sized = _setjoin.shared_entries(entries.withColumn("part", F.floor(F.log2("n")).cast("long")), "test")
    for rows, rounds, piece, hot in ((live, 0, 3, 1), (live, 2, 5, 20), (sized, 1, 4096, 1), (sized, 2, 4, 50)):
        got = {r.node: r.root for r in _setjoin.like_sets(rows, lambda nodes: df.join(nodes, "node"), 0.5, "test", rounds, piece, hot).collect()}
        assert {i: got.get(i, i) for i in sets} == {i: find(i) for i in sets}


def test_a_large_group_of_near_copies_costs_few_pairs(spark, monkeypatch):
    rng = random.Random(12)
    sets = {i: sorted({*range(41)} - {*rng.sample(range(41), i % 5)} | {1000 + 10 * i + j for j in range(i % 5)}) for i in range(300)}
    df, _ = settle(spark.createDataFrame(list(sets.items()), "node long, s array<long>"), "test-sets")
    entries = df.select("node", F.posexplode(F.slice("s", F.lit(1), _setjoin.prefix_size(F.size("s"), 0.8))).alias("pos", "h")).select("h", "pos", "node")
    about = df.select("node", F.size("s").alias("n"), *_setjoin.sketch(F.col("s")))
    live = _setjoin.shared_entries(entries, "test", about)
    asked = []

    def counting(rows, label):
        out = settle(rows, label)
        asked.extend([out[0].count()] if label == "test-pairs" else [])
        return out

    monkeypatch.setattr(_setjoin, "settle", counting)
    got = {r.node: r.root for r in _setjoin.like_sets(live, lambda nodes: df.join(nodes, "node"), 0.8, "test", small=0).collect()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = 0
    for a, b in itertools.combinations(sets, 2):
        if len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a], *sets[b]}):
            root[max(find(a), find(b))] = min(find(a), find(b))
            linked += 1
    assert {i: got.get(i, i) for i in sets} == {i: find(i) for i in sets}
    assert linked > 10_000 and sum(asked) < 10 * len(sets)


def test_sketches_bound_the_difference_from_below(spark):
    rng = random.Random(6)
    sets = [sorted(rng.sample(range(400), rng.randrange(0, 200))) for _ in range(30)]
    df = spark.createDataFrame([(s,) for s in sets], "s array<int>").select("s", *_setjoin.sketch(F.col("s")))
    words = [c for c in df.columns if c != "s"]
    held = [({*r.s}, [r[w] & (1 << 64) - 1 for w in words]) for r in df.collect()]
    far = [(sum((x ^ y).bit_count() for x, y in zip(p, q, strict=True)), len(a ^ b)) for (a, p), (b, q) in itertools.combinations(held, 2)]
    assert len(words) == _setjoin.WORDS and all(x <= y and (x - y) % 2 == 0 for x, y in far) and sum(x for x, _ in far) > 10 * len(far)


def test_joins_on_the_bucket_column_leave_the_rows_in_place(spark):
    rows = _tables.bucketed(spark.range(500).select("id", F.md5(F.col("id").cast("string")).alias("m")), "id", "test-dealt")
    asked, _ = settle(spark.range(0, 500, 7).toDF("id"), "test-asked")
    found = rows.join(asked.hint("merge"), "id")
    assert found.count() == 72 and rows.count() == 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_components_by_one_task_and_by_rounds(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    df = spark.createDataFrame(edges, "a long, b long")
    one, many = ({(r.node, r.root) for r in _components.components(df, small=n).collect()} for n in (1 << 20, 0))
    assert one == many and len(one) > 50 and _components.components(df.where("false")).collect() == []


def test_spots_of_odd_texts(spark):
    df = spark.createDataFrame([(1, "of " * 50000), (2, "x" * 100000), (3, "123 !!"), (4, None), (5, "The"), (6, "of the copper " * 300_000)], SCHEMA)
    got = {r.doc_id: len(r.signatures) for r in spotsigs.signatures(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2}
    assert spotsigs.signatures(df.where("false")).collect() == []


def slow_contained(docs, items):
    out = set()
    for j, item in items:
        s = decontaminate.shingles((item or "").lower())
        n = min(5, len(decontaminate.words((item or "").lower())))
        for i, text in docs:
            shared = len(s & decontaminate.shingles((text or "").lower(), n)) if s else 0
            if s and len(decontaminate.words((text or "").lower())) >= n and shared >= 0.8 * len(s) - 1e-9:
                out.add((i, j, shared, len(s)))
    return out


def test_containment_against_brute_force(spark):
    rng = random.Random(2)
    items = [(j, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 4, 5, 9, 20, 60])))) for j in range(30)] + [(90, None), (91, "!?"), (92, "Solo"), (93, "solo"), (94, "Solo")]
    docs = []
    for i in range(60):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 300))]
        if i % 3 == 0:
            t = rng.choice(items[:30])[1].split()
            if len(t) > 10 and i % 2:
                t[rng.randrange(len(t))] = "changed"
            words[rng.randrange(len(words) + 1) : 0] = t
        docs.append((i, " ".join(words).upper() if i % 5 == 0 else ",\n".join(words)))
    docs += [(70, None), (71, ""), (72, "solo"), (72, "solo")]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    it = spark.createDataFrame(items, "item_id long, text string")
    want = slow_contained(docs, items)
    for block in (1 << 18, 40):
        got = decontaminate.contained(d, it, block=block).collect()
        assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got} == want and len(want) > 10
        assert sum(r.doc_id == 72 for r in got) == 6
        clean = decontaminate.without_items(d, it, block=block)
        assert clean.columns == d.columns
        assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {w[0] for w in want}
    assert decontaminate.contained(d, it.where("false")).collect() == [] == decontaminate.contained(d.where("false"), it).collect()
    assert all(decontaminate.sketch_size(n) >= 1 for n in range(1, 200))
