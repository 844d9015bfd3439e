"""Language identification: the family first, then linear support vector machines within it.

Features are frequencies of hashed byte trigrams of the lower-cased text, with all
that is no letter read as one blank. A one-versus-rest family of linear classifiers
(hinge loss) picks the language family; within it, one-versus-one support vector
machines vote between its languages. Families are given for common languages; a
language of no known family is a family of its own.

Only text is an input. The sample that is fitted is bounded (SAMPLE documents of each
language); every row is scored in one pass over whole texts.

Edge cases: a null or letterless text is `und` with score 0; a table with one language
predicts it; with none to learn from, all are `und`; ties go to the first language by
name; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._fit import bounded, gather, held_out, sums
from ._tables import read, small_batches
from ._text import LETTER, LOWER, text_chunks

#: Documents of a language that are fitted, at most and in expectation.
SAMPLE = 1500
BITS = 12
FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "is", "af"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ro", "ca", "gl"), "romance"),
    **dict.fromkeys(("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"), "slavic"),
    **dict.fromkeys(("fi", "et", "hu"), "uralic"),
    **dict.fromkeys(("tr", "az", "kk", "uz"), "turkic"),
    **dict.fromkeys(("hi", "mr", "ne", "bn", "ur", "fa"), "indo-iranian"),
    **dict.fromkeys(("ar", "he", "am"), "semitic"),
}
_FOLD = np.where(LETTER, LOWER, 32).astype(np.uint32)


def trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigram at each byte, and for each document the range of its own."""
    x = _FOLD[data]
    n = max(0, x.size - 2)
    h = x[:n] * np.uint32(0x9E3779B1)
    h += x[1 : n + 1] * np.uint32(0x85EBCA77)
    h ^= x[2 : n + 2] * np.uint32(0xC2B2AE3D)
    h *= np.uint32(0x27D4EB2F)
    h >>= np.uint32(32 - BITS)
    begin = np.minimum(offs[:-1], n)
    return h, begin, np.maximum(np.minimum(offs[1:] - 2, n), begin)


def _features(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    h, begin, end = trigrams(data, offs)
    return [h[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def hinge(x: np.ndarray, y: np.ndarray, rounds: int = 12, penalty: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Weights (last: bias) of a linear support vector machine by averaged stochastic subgradients; y is -1 or 1."""
    rng = np.random.default_rng(seed)
    w, mean = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * y.size
    t = taken = 0
    for lap in range(rounds):
        order = rng.permutation(y.size)
        for at in range(0, y.size, 32):
            rows = order[at : at + 32]
            t += 1
            rate = 1 / (penalty * (t + 1 / penalty))
            part = x[rows]
            out = part @ w[:-1] + w[-1]
            g = np.where(y[rows] * out < 1, y[rows] * weight[rows], 0) / rows.size
            w *= 1 - rate * penalty
            w[:-1] += rate * (g @ part)
            w[-1] += rate * 0.1 * g.sum()
            if lap >= rounds // 2:
                taken += 1
                mean += (w - mean) / taken
    return mean


class Model:
    """Weights by family and by pair of languages of one family."""

    def __init__(self, features: list[np.ndarray], langs: list[str]):
        self.langs = sorted(set(langs))
        family = {lang: FAMILIES.get(lang.lower().split("-")[0], lang) for lang in self.langs}
        self.families = {f: [x for x in self.langs if family[x] == f] for f in sorted(set(family.values()))}
        size = 1 << BITS
        x = np.zeros((len(features), size), np.float32)
        for i, f in enumerate(features):
            x[i] = np.bincount(f, minlength=size) / max(1, f.size)
        self.scale = 1 / np.sqrt(np.einsum("ij,ij->j", x, x, dtype=np.float64) / max(1, len(features)) + 1e-8)
        x *= self.scale.astype(np.float32)
        y = np.array(langs)
        columns = []
        every = np.arange(y.size)
        self.family_at, self.pair_at = {}, {}

        def learn(positive: np.ndarray, rows: np.ndarray) -> int:
            part = x if rows is every else x[rows]
            w = hinge(part, np.where(positive[rows], 1.0, -1.0))
            # a margin as large as the median one is read as 0.95, whatever the features' scale
            columns.append(w * (1.5 / max(1e-9, float(np.median(np.abs(part @ w[:-1] + w[-1]))))))
            return len(columns) - 1

        names = np.array([family[v] for v in langs])
        if len(self.families) > 1:
            for f in self.families:
                self.family_at[f] = learn(names == f, every)
        for members in self.families.values():
            for i, a in enumerate(members):
                for b in members[i + 1 :]:
                    self.pair_at[a, b] = learn(y == a, np.flatnonzero((y == a) | (y == b)))
        w = np.array(columns).reshape(len(columns), size + 1)
        self.weights, self.bias = w[:, :-1] * self.scale, w[:, -1]

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number, score) of each document."""
        h, begin, end = trigrams(data, offs)
        size = np.maximum(1, end - begin)
        out = [sums(w[h], begin, end) / size + b for w, b in zip(self.weights, self.bias, strict=True)]
        n = offs.size - 1
        lang, score = np.zeros(n, np.int64), np.ones(n)
        names = list(self.families)
        best = np.zeros(n, np.int64)
        if self.family_at:
            margins = np.array([out[self.family_at[f]] for f in names])
            best = margins.argmax(axis=0)
            score = 1 / (1 + np.exp(-np.clip(2 * margins.max(axis=0), -30, 30)))
        for k, f in enumerate(names):
            members = self.families[f]
            own = best == k
            votes, sure = np.zeros((len(members), n)), np.ones((len(members), n))
            for i, a in enumerate(members):
                for j, b in [(j, b) for j, b in enumerate(members) if j > i]:
                    m = out[self.pair_at[a, b]]
                    p = 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))
                    votes[i] += m >= 0
                    votes[j] += m < 0
                    sure[i] = np.minimum(sure[i], p)
                    sure[j] = np.minimum(sure[j], 1 - p)
            top = (votes + 1e-6 * sure).argmax(axis=0)
            lang[own] = np.array([self.langs.index(m) for m in members])[top[own]]
            score[own] *= sure[top, np.arange(n)][own]
        return lang, score


def fit(docs: DataFrame, usable: F.Column, sample: int = SAMPLE, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("label"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = rows.select("label", "id", "text")
    features, langs = gather(bounded(counted, "label", "id", sample), _features, "string")
    return Model(features, langs)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = pa.array([*known.langs, "und"])
        for batch in batches:
            lettered = batch.column(2).to_numpy(zero_copy_only=False)
            lang, score = np.full(batch.num_rows, len(known.langs)), np.zeros(batch.num_rows)
            if known.langs:
                for a, b, data, offs in text_chunks(batch, "text"):
                    lang[a:b], score[a:b] = known.predict(data, offs)
                lang[~lettered], score[~lettered] = len(known.langs), 0
            yield pa.RecordBatch.from_arrays([batch.column(0), names.take(pa.array(lang)), pa.array(score)], [id_col, "lang_pred", "score"])

    lettered = F.coalesce(text.rlike("\\p{L}"), F.lit(False))
    return docs.select(F.col(id_col), text.alias("text"), lettered.alias("lettered")).mapInArrow(scan, f"`{id_col}` {kind}, lang_pred string, score double")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, ~held_out("doc_id", 4, 2))
    found = predict(docs, model)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
