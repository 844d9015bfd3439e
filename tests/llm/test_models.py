"""Classifiers on held-out rows, and their edge cases."""

import random
import tracemalloc
import zlib

import numpy as np
import pytest

from tesserae.llm import language, quality, toxicity
from tesserae.llm._fit import Rows

STEMS = {"en": "the and with house river garden stone yellow ing tion ness", "de": "der und mit haus fluss garten stein gelb ung heit keit", "fr": "le et avec maison fleuve jardin pierre jaune eau tion ment", "es": "el y con casa rio jardin piedra amarillo cion mente idad"}


def text_of(lang, rng, n):
    w = STEMS[lang].split()
    return " ".join(rng.choice(w) + rng.choice(["", "", rng.choice(w)]) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(0)
    folder = str(tmp_path_factory.mktemp("sf"))
    docs, labels = [], []
    for i in range(700):
        lang = rng.choice(list(STEMS))
        t = text_of(lang, rng, rng.randrange(20, 120))
        bad, toxic = i % 6 == 0, i % 4 == 0
        if bad:
            t = " ".join(f"{w}{rng.choice(['&&&', '%%%', '###'])}" for w in t.split())
        if toxic:
            w = t.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "scumbag", "loweist", "loweiung"]))
            t = " ".join(w)
        docs.append((i, t, lang if i % 10 else None, "s"))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(1000, None, "en", "s"), (1001, "", None, "s"), (1002, "123 !!", "de", "s"), (None, "no name", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, score string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {d[0]: d for d in docs}, {x[0]: x for x in labels}


def accuracy(rows, truth):
    return np.mean([p == truth[i] for i, p in rows])


def test_language(spark, tables):
    folder, docs, _ = tables
    got = language.op4_language(spark, folder).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    held = [(r.doc_id, r.lang_pred) for r in got if r.held_out and docs[r.doc_id][2] and r.doc_id < 1000]
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in held)
    assert accuracy(held, {i: d[2] for i, d in docs.items()}) > 0.97
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id and r.doc_id >= 1000} == dict.fromkeys((1000, 1001, 1002), "und")


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_scores(spark, tables, name):
    folder, docs, labels = tables
    query, at, rule, edge = (quality.op7_quality, 1, (5, 0), 0.3) if name == "quality" else (toxicity.op9_toxicity, 2, (3, 1), 0.7)
    got = query(spark, folder).collect()
    assert len(got) == len(docs)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= edge)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % rule[0] == rule[1])
    held = [(r.doc_id, r.predicted) for r in got if r.held_out and r.doc_id in labels]
    assert accuracy(held, {i: x[at] for i, x in labels.items()}) > 0.95
    again = {r.doc_id: r.score for r in query(spark, folder).collect()}
    assert again == {r.doc_id: r.score for r in got}


def test_one_kind_of_label_or_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    same = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    for labels, want in ((none, 0.5), (same, 1.0)):
        for fit in (quality.fit, toxicity.fit):
            assert {r.score for r in toxicity.score(docs, fit(docs, labels, F.lit(True))).collect()} == {want}
    empty = docs.where("false").withColumn("lang", F.lit("en"))
    model = language.fit(empty, F.lit(True))
    assert {r.lang_pred for r in language.predict(docs, model).collect()} == {"und"} and language.predict(empty, model).collect() == []


def test_pairs_matter():
    """An insult and a group together are toxic, either alone is not: no additive weight can tell."""
    rng = np.random.default_rng(1)
    rows, y = [], []
    for k in range(900):
        a, b = (k % 3 != 0), (k % 3 != 1)
        noise = rng.integers(1000, 1200, 6).tolist()
        rows.append(np.array(sorted({*noise, *([1] if a else []), *([2] if b else [])})))
        y.append(int(a and b))
    m = toxicity.Machine(Rows(rows, np.array(y)))
    out = []
    for r in rows:
        r = r[m.w[r] != 0]
        s = m.v[r].sum(axis=0)
        out.append(m.bias + m.w[r].sum() + 0.5 * ((s**2).sum() - m.square[r].sum()) > 0)
    assert np.mean(np.array(out) == np.array(y)) > 0.97


def slow_terms(text):
    import re

    words = re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").lower().encode())
    return {w for w in words} | {(n, w[:n]) for w in words for n in toxicity.STEMS if len(w) > n}


def test_toxicity_against_a_slow_scorer(spark, tables):
    """Scores of the query equal the sum over terms and pairs of terms, one by one."""
    folder, docs, _ = tables
    d, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    m = toxicity.fit(d, labels, ~toxicity.held_out("doc_id", 3, 1))
    got = {r.doc_id: r.score for r in toxicity.op9_toxicity(spark, folder).collect()}
    for i in [0, 4, 5, 8, 31, 1000, 1001, 1002]:
        low = (docs[i][1] or "").lower().encode()
        data = np.frombuffer(low, np.uint8)
        _, terms = toxicity.terms(data, np.array([0, data.size]))
        assert len(terms) == len(slow_terms(docs[i][1]))
        total = m.bias + sum(float(m.w[t]) for t in terms)
        total += sum(float(np.dot(m.v[a], m.v[b])) for k, a in enumerate(terms) for b in terms[:k])
        assert abs(got[i] - 1 / (1 + np.exp(-total))) < 1e-4


def test_very_long_texts(spark):
    """Texts of some megabytes are scored and predicted like any other."""
    docs = spark.createDataFrame([(1, "the house and river " * 150_000, "en"), (2, "der fluss und haus " * 9, "de"), (3, "a" * 3_000_000, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    for fit in (quality.fit, toxicity.fit):
        assert all(0 <= r.score <= 1 for r in toxicity.score(docs, fit(docs, labels, F.lit(True))).collect())
    assert {r.doc_id for r in language.predict(docs, language.fit(docs, F.lit(True))).collect()} == {1, 2, 3}


def test_fitting_quality_holds_little_next_to_its_rows():
    rng = np.random.default_rng(4)
    features = [rng.integers(0, 1 << quality.BITS, 1500).astype(np.int32) for _ in range(600)]
    rows = Rows(features, np.arange(600) % 2)
    tracemalloc.start()
    quality.Network(rows, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 35e6
