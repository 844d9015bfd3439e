"""The pipeline's stages on planted rows, and the registered names."""

import random

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline

WORDS = "harbor window yellow quiet measure barrel orchard signal velvet copper lantern meadow the of and to".split()


def say(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed"]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("corpus"))
    clean = {i: say(i, 80) for i in range(60)}
    docs = dict(clean)
    docs |= {100 + i: " ".join(f"{w}&&&" for w in say(500 + i, 60).split()) for i in range(30)}
    docs |= {200: clean[3], 201: clean[3]}
    passage = say(900, 60)
    docs |= {210: say(901, 40) + " " + passage, 211: passage + " " + say(902, 40)}
    item = say(903, 30)
    docs |= {220: say(904, 30) + " " + item + " " + say(905, 20), 230: None}
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(60), *range(100, 130)]], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item), (2, say(906, 25))], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, docs, passage


def test_stages(spark, folder):
    path, docs, passage = folder
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    at = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at, _ = corpus_pipeline.settle(stage(spark, at, path), "test")
        assert tuple(at.columns) == corpus_pipeline.COLUMNS
        kept[name] = {r.doc_id: r.text for r in at.collect()}
    first, near, cut, last = (kept[n] for n in names[:-1])
    assert set(range(60)) <= set(first) and not set(range(100, 130)) & set(first)
    assert 3 in near and not {200, 201} & set(near) and set(range(60)) <= set(near)
    assert passage[:200] not in cut[210] and passage[:200] not in cut[211] and cut[5] == docs[5]
    assert 220 not in last and set(range(60)) <= set(last)


def test_run(spark, folder):
    pieces = corpus_pipeline.run(spark, folder[0]).toPandas()
    assert set(range(60)) - {3} <= set(pieces.doc_id) and 220 not in set(pieces.doc_id)
    assert (pieces.groupby("sequence_id").length.sum() <= 2048).all()


def test_names():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_containment_sql(spark, folder):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder[0]}/{t}.parquet/*.parquet'")
    rel = con.sql(__spark_entry__.oracle_sql()["op5_decontaminate"])
    want = sorted(zip(*[rel.fetchnumpy()[c].tolist() for c in ("doc_id", "item_id", "n_shared", "n_item", "containment")], strict=True))
    got = __spark_entry__.queries()["op5_decontaminate"](spark, folder[0]).collect()
    assert sorted((r.doc_id, r.item_id, r.n_shared, r.n_item, r.containment) for r in got) == want and want
