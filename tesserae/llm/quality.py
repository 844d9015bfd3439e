"""Quality by random-indexing word vectors and a small calibrated network.

Tokens are lower-cased words, runs of punctuation, the shape of each word (case,
digits, length) and a mark where a word repeats the one before it. A token's random
index is a sparse vector of a few signs drawn from its hash; its word vector adds the
indexes of its neighbours over the fitted texts. A document is the mean of its tokens'
vectors with the logarithm of its length; a network of two layers, in numpy, scores
it, and one temperature, fitted on documents set aside, calibrates its probability.

Only text is an input. The sample that is fitted is bounded (SAMPLE documents of each
label); every row is scored in one pass over whole texts.

Edge cases: null and empty texts have the vector zero and are scored as such; with no
labelled rows, or labels of one kind, the score is their share (0.5 without any);
repeated rows score alike; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._fit import Rows, gather, held_out, labelled
from ._tables import read, release
from ._text import LETTER, LOWER, SPACE, WORD, prefix_sums, range_hash, runs
from .toxicity import score

#: Documents of a label that are fitted, at most and in expectation.
SAMPLE = 4000
BITS, WIDTH, SIGNS, HIDDEN, SPAN = 15, 48, 6, 32, 2
#: Tokens whose neighbours are added at a time.
STEP = 1 << 14
THRESHOLD = 0.3
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, hashed tokens) in text order; the last 1024 numbers are shapes and marks."""
    mark = (1 << BITS) - 1024
    low = LOWER[data]
    prefix = prefix_sums(low)
    s, e = runs(WORD[data], offs)
    p, q = runs(~WORD[data] & ~SPACE[data], offs)
    word = range_hash(prefix, s, e)
    n = np.minimum(e - s, 15)

    def within(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return total[e] - total[s]

    upper, digit = within(_UPPER[data]), within(_DIGIT[data])
    case = np.where(digit > 0, 4, np.where(upper == 0, 0, np.where(upper >= e - s, 3, np.where(_UPPER[data[s]] & (upper == 1), 1, 2)))) if s.size else np.zeros(0, np.int64)
    doc = np.searchsorted(offs, s, "right") - 1
    again = np.zeros(s.size, bool)
    again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    kind = np.concatenate([(word % np.uint64(mark)).astype(np.int64), (range_hash(prefix, p, q) % np.uint64(mark)).astype(np.int64), mark + case * 16 + n, np.full(int(again.sum()), mark + 512)])
    at = np.concatenate([s * 3, p * 3, s * 3 + 1, s[again] * 3 + 2])
    order = np.argsort(at, kind="stable")
    return np.searchsorted(offs, at[order] // 3, "right") - 1, kind[order]


def _features(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    doc, token = tokens(data, offs)
    return np.split(token, np.searchsorted(doc, np.arange(1, offs.size - 1)))


def random_indexes(seed: int = 5) -> np.ndarray:
    """A sparse vector of signs for each token bucket."""
    rng = np.random.default_rng(seed)
    out = np.zeros((1 << BITS, WIDTH), np.float32)
    for _ in range(SIGNS):
        out[np.arange(1 << BITS), rng.integers(0, WIDTH, 1 << BITS)] += rng.choice(np.array([-1, 1], np.float32), 1 << BITS)
    return out


class Network:
    """Word vectors, two layers and a temperature."""

    def __init__(self, rows: Rows, rounds: int = 60, rate: float = 0.01, seed: int = 3):
        y = np.asarray(rows.labels, np.float64)
        share = float(y.mean()) if y.size else 0.5
        self.constant = share if not y.size or share in (0.0, 1.0) else None
        if self.constant is not None:
            return
        index = random_indexes()
        context = np.zeros_like(index)
        flat = rows.flat
        row = np.repeat(np.arange(len(rows), dtype=np.int32), rows.offs[1:] - rows.offs[:-1])
        # sums of signs, so exact whatever the step
        for at in range(0, flat.size, STEP):
            for k in range(1, SPAN + 1):
                a, b = flat[at : at + STEP], flat[at + k : at + k + STEP]
                a = a[: b.size]
                near = row[at : at + b.size] == row[at + k : at + k + b.size]
                a, b = a[near], b[near]
                np.add.at(context, a, index[b])
                np.add.at(context, b, index[a])
        del row
        norm = np.linalg.norm(context, axis=1, keepdims=True)
        self.vectors = index / np.float32(np.sqrt(SIGNS)) + context / np.maximum(norm, np.float32(1e-6))
        x = np.zeros((len(rows), WIDTH + 1))
        for i in range(len(rows)):
            own = flat[rows.offs[i] : rows.offs[i + 1]]
            x[i, :-1] = self.vectors[own].mean(axis=0) if own.size else 0
            x[i, -1] = np.log1p(own.size)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        aside = np.arange(y.size) % 5 == 4
        if len(set(y[aside])) < 2:
            aside[:] = False
        learn = np.flatnonzero(~aside)
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        rng = np.random.default_rng(seed)
        p = [rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH + 1, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(rounds):
            order = rng.permutation(learn)
            for at in range(0, order.size, 64):
                own = order[at : at + 64]
                h = np.tanh(x[own] @ p[0] + p[1])
                out = h @ p[2] + p[3]
                g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[own]) * weight[own] / own.size
                back = g[:, None] * p[2] * (1 - h**2)
                grad = [x[own].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
                t += 1
                for k in range(4):
                    m[k] = 0.9 * m[k] + 0.1 * grad[k]
                    v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.layers = p
        self.temperature = 1.0
        check = np.flatnonzero(aside)
        if check.size:
            out = np.tanh(x[check] @ p[0] + p[1]) @ p[2] + p[3]
            grid = np.exp(np.linspace(-1.5, 3, 91))
            loss = [(weight[check] * np.logaddexp(0, np.where(y[check] > 0, -out, out) / k)).sum() for k in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = offs.size - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        doc, token = tokens(data, offs)
        x = np.zeros((n, WIDTH + 1))
        count = np.bincount(doc, minlength=n)
        some = np.flatnonzero(count)
        if some.size:
            begin = np.searchsorted(doc, some)
            x[some, :-1] = np.add.reduceat(self.vectors[token], begin, axis=0) / count[some, None]
        x[:, -1] = np.log1p(count)
        x = (x - self.mean) / self.scale
        p = self.layers
        out = (np.tanh(x @ p[0] + p[1]) @ p[2] + p[3]) / self.temperature
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, usable: F.Column, sample: int = SAMPLE, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Network:
    features, y = gather(labelled(docs, labels, label_col, usable, sample, id_col, text_col), _features, "int")
    rows = Rows(features, np.array(y))
    del features
    release()
    model = Network(rows)
    del rows
    release()
    return model


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit(docs, labels, ~held_out("doc_id", 5, 0))
    return score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
