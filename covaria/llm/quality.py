"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has two tokens: itself and its shape (runs of capitals, small letters and digits become
one letter each, other characters stay; a word that repeats the one before has a shape of its own),
both hashed to fixed numbers of buckets, so that a table of them has a bounded size whatever the
corpus says. A bucket's vector is the sum of the sparse random index vectors of the buckets seen
within two words of it, in all documents: tasks add up what their rows hold, Spark adds up the tasks.
The same pass weighs the buckets by their share of each document, so the mean of all documents is
known too. A document is the mean vector of its words beside the mean vector of its shapes, drawn
towards that mean as if by ``PRIOR`` more words, since a few words say little; a network of two
layers gives a logit, and a temperature fitted on rows set aside makes a probability of it.

The network is fitted on at most ``MAX_ROWS`` labelled rows, chosen by a hash of their ids and texts,
none of them held out; they come to the driver as pooled vectors, never as texts. Rows are scored
where they are read, without a shuffle.

Defined cases: null and empty texts score as the mean of all documents does; labels that are
null or belong to no document are ignored, several labels of one document each count; with no
label of one kind every document scores the share of label 1 (1 without any); null ids count as held
out; repeated rows are scored alike; an empty table gives an empty result; other columns stay, and
held_out, score and predicted replace columns of the same name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out

MAX_ROWS = 6000
WORDS, SHAPES, DIM, HIDDEN, NEAR, PRIOR = 1 << 14, 1 << 10, 64, 32, 2, 8
HELD_OUT = (5, 0)
THRESHOLD = 0.3
#: Words whose vectors are in memory at once.
AT_ONCE = 1 << 15

_LETTERS, _DIGITS, _AGAIN = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(\W)\1+")


def _cased(run: str) -> str:
    return "A" if run.isupper() else "a" if run.islower() else "Aa"


def shape_of(word: str) -> str:
    if word.isalpha():  # most words are letters, and perhaps a sign
        return _cased(word)
    if word[:-1].isalpha() and not word[-1].isdigit():
        return _cased(word[:-1]) + word[-1]
    return _AGAIN.sub(r"\1\1", _DIGITS.sub("0", _LETTERS.sub(lambda m: _cased(m[0]), word)))


class Tokens(dict):
    """Word to the code of its two buckets; forgets all when it has grown large."""

    def __init__(self):
        self.shapes: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
            self.shapes.clear()
        shape = shape_of(word)
        bucket = self.shapes.get(shape)
        if bucket is None:
            bucket = xxhash.xxh32_intdigest(shape) % (SHAPES - 1) + 1
        code = xxhash.xxh32_intdigest(word.lower()) % WORDS * SHAPES + bucket
        if len(word) < 100:  # so that what is kept is bounded in bytes too
            self[word], self.shapes[shape] = code, bucket
        return code

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        codes = np.array([self[w] for w in (text or "").split()], np.int32)
        words, shapes = codes // SHAPES, codes % SHAPES + WORDS
        shapes[1:][codes[1:] == codes[:-1]] = WORDS  # bucket 0: said again
        return words, shapes


def index_vectors(seed: int = 0) -> np.ndarray:
    """A sparse random vector of -1, 0 and 1 for each bucket."""
    return np.random.default_rng(seed).choice(np.array([-1, 0, 1], np.float32), (WORDS + SHAPES, DIM), p=[0.05, 0.9, 0.05])


def _added(into: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """into[at] += rows, where places may repeat."""
    order = np.argsort(at, kind="stable")
    sorted_at = at[order]
    first = np.flatnonzero(np.diff(sorted_at, prepend=-1))
    into[sorted_at[first]] += np.add.reduceat(rows[order], first, axis=0)


def _counted(batches):
    """Of a task's documents, for each bucket seen: its neighbours' index vectors summed, and its shares of documents."""
    n, tokens = WORDS + SHAPES, Tokens()
    index = np.append(index_vectors(), np.zeros((1, DIM), np.float32), axis=0)  # bucket n: between documents
    met, mass = np.zeros((n + 1, DIM)), np.zeros(n + 1)

    def add(words: np.ndarray, shapes: np.ndarray, share: np.ndarray) -> None:
        for at in range(0, len(words), AT_ONCE):
            low, end = max(0, at - NEAR), min(len(words), at + AT_ONCE)
            own = index[words[low : end + NEAR]] + index[shapes[low : end + NEAR]]
            near = np.zeros_like(own)
            for k in range(1, NEAR + 1):
                near[k:] += own[:-k]
                near[:-k] += own[k:]
            for ids in (words[at:end], shapes[at:end]):
                _added(met, ids, near[at - low : end - low])
                mass[:] += np.bincount(ids, share[at:end], n + 1)

    between, held, many = np.full(NEAR, n, np.int32), [], 0
    for rows in batches:
        for text in rows["text"]:
            words, shapes = tokens.of(text)
            if len(words):
                held.append((words, shapes, np.full(len(words), 1 / len(words))))
                held.append((between, between, np.zeros(NEAR)))
                many += len(words)
            if many >= AT_ONCE:
                add(*map(np.concatenate, zip(*held, strict=True)))
                held, many = [], 0
    if held:
        add(*map(np.concatenate, zip(*held, strict=True)))
    seen = np.nonzero(mass[:n])[0]
    yield pd.DataFrame({"bucket": seen, "mass": mass[seen], **{f"v{i}": met[seen, i] for i in range(DIM)}})


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The unit vectors of all buckets, and the mean of all documents; what comes to the driver is a row a bucket."""
    columns = ["mass", *[f"v{i}" for i in range(DIM)]]
    parts = docs.select("text").mapInPandas(_counted, "bucket int, " + ", ".join(f"{c} double" for c in columns))
    rows = np.array(parts.groupBy("bucket").agg(*[F.sum(c) for c in columns]).collect(), float).reshape(-1, DIM + 2)
    vectors, mass, at = np.zeros((WORDS + SHAPES, DIM)), np.zeros(WORDS + SHAPES), rows[:, 0].astype(int)
    mass[at], vectors[at] = rows[:, 1], rows[:, 2:]
    vectors = np.sign(vectors) * np.log1p(np.abs(vectors))  # so that frequent neighbours don't outweigh all others
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
    full = max(mass[:WORDS].sum(), 1e-9)  # documents with words
    centre = np.concatenate([mass[:WORDS] @ vectors[:WORDS], mass[WORDS:] @ vectors[WORDS:]]) / full
    return vectors.astype(np.float32), centre


@dataclass
class Network:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def pooled(self, document: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        words, shapes = document
        if not len(words):
            return np.zeros(2 * DIM + 1)
        sides = [sum(self.vectors[ids[at : at + AT_ONCE]].sum(0, dtype=float) for at in range(0, len(ids), AT_ONCE)) / len(ids) for ids in (words, shapes)]
        return np.concatenate([*sides, [len(words) / (len(words) + PRIOR)]])

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return (x[:, :-1] - self.centre) / self.scale * x[:, -1:]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.inputs(x) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def fit(vectors: np.ndarray, centre: np.ndarray, x: np.ndarray, labels: list[int], seed: int = 0) -> Network | float:
    """The network over pooled documents x, or where there is nothing to tell apart the score of every document."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 1.0
    rng = np.random.default_rng(seed)
    net = Network(vectors, centre, x[:, :-1].std(0) + 1e-3, rng.normal(0, (2 * DIM) ** -0.5, (2 * DIM, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    aside = rng.random(len(y)) < 0.2
    train, check = (np.nonzero(~aside)[0], np.nonzero(aside)[0]) if aside.any() and len(set(y[~aside])) == 2 else (np.arange(len(y)),) * 2
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) ** 0.5
    moments = {k: [0.0, 0.0] for k in ("w1", "b1", "w2", "b2")}
    z = net.inputs(x)
    for step in range(1, 1501):
        rows = rng.choice(train, min(256, len(train)))
        h = np.tanh(z[rows] @ net.w1 + net.b1)
        off = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -60, 60))) - y[rows]) * weight[rows] / len(rows)
        back = np.outer(off, net.w2) * (1 - h * h)
        slopes = {"w1": z[rows].T @ back + 1e-4 * net.w1, "b1": back.sum(0), "w2": h.T @ off + 1e-4 * net.w2, "b2": off.sum()}
        for k, g in slopes.items():
            m = moments[k]
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
            setattr(net, k, getattr(net, k) - 0.003 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8))
    raw = net.logit(x[check])
    loss = lambda t: np.mean(np.logaddexp(0, -raw / t * (2 * y[check] - 1)))
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def labelled(docs: DataFrame, labels: DataFrame, target: str, split: tuple[int, int], max_rows: int) -> DataFrame:
    """The documents of at most max_rows training labels: (doc_id, text, label, turn); of repeated ids there may be more, those of the first turns count.

    Labels of absent documents leave first, so that they take no other's place.
    """
    usable = labels.where(~held_out(F.col("doc_id"), *split) & F.col(target).isNotNull()).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = usable.select("doc_id", F.col(target).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_rows pairs of numbers
    return found.withColumn("turn", F.struct(F.xxhash64("doc_id"), F.xxhash64("text"), "label"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Network | float:
    vectors, centre = word_vectors(docs)
    found = labelled(docs, labels, "quality", HELD_OUT, max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    rows = found.select("turn", "label", _pooled(shared, F.col("text")).alias("x")).orderBy("turn", "x").limit(max_rows).select("label", "x").collect()
    shared.destroy()
    return fit(vectors, centre, np.array([r.x for r in rows]).reshape(-1, 2 * DIM + 1), [r.label for r in rows])


def _pooled(shared, text: Column) -> Column:
    tokens = Tokens()

    def of(texts: pd.Series) -> pd.Series:
        model = Network(shared.value, *[None] * 6)
        return pd.Series([model.pooled(tokens.of(t)) for t in texts])

    return F.pandas_udf(of, "array<double>")(text)


def scored(docs: DataFrame, model: Network | float) -> DataFrame:
    """docs with held_out, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB whatever the corpus
    out = docs.withColumn("held_out", held_out(F.col("doc_id"), *HELD_OUT)).withColumn("score", _score(shared, F.col("text")))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _score(shared, text: Column) -> Column:
    tokens = Tokens()

    def scores(texts: pd.Series) -> pd.Series:
        model = shared.value
        if isinstance(model, float):
            return pd.Series(np.full(len(texts), model))
        return pd.Series(model.score(np.array([model.pooled(tokens.of(t)) for t in texts]).reshape(-1, 2 * DIM + 1)))

    return F.pandas_udf(scores, "double")(text)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of op1."""
    return scored(docs.select("doc_id", "text"), train(docs, labels)).select("doc_id", "held_out", "score", "predicted")
