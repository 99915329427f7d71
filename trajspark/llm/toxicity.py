"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of itself and of its character n-grams (hashed, with word edges
marked); a document's is the mean over its words; a softmax of two classes stands on top. Embeddings and softmax
are trained jointly in numpy on a bounded sample of labelled documents. A misspelling never seen before shares
most n-gram vectors with the word that it comes from.

Both layers are linear, so scoring needs one number for each hashed n-gram: its vector times the difference of the
class weights. Executors get those numbers only (4 << BITS bytes, whatever the input) and keep the score of words
that come again.

Null and empty texts, and texts without a word, get the score of the bias alone. Very long texts are scored whole; in
training their words are counted before documents meet in one task. Labels of unknown documents, null labels and
repeated labels (the larger counts) are harmless; without both classes among the labels every score is the share of
toxic labels, 0 without any. Equal texts, and so repeated rows, get equal scores; a score of exactly `below` is
rejected by `keep`. An empty table gives no scores. Other columns are ignored by `score` and kept by `keep`.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, id_and_text, kept_rows, per_batch, trained

#: Buckets of hashed n-grams (as a power of 2), n-gram sizes, and dimensions of their vectors.
BITS, SIZES, DIMENSIONS = 18, (3, 4, 5, 6), 8

#: Labelled documents used for training, at most about so many of each class, chosen by a hash of doc_id.
SAMPLE_OF_CLASS = 2500

#: Training documents that a hashed n-gram must occur in to get a vector of its own; others have none.
LEAST = 3

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, total: float, words: int) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.bias + (total / words if words else 0.0)))))


def buckets(word: str) -> np.ndarray:
    """Of the word itself and its n-grams."""
    marked = f"<{word}>"
    grams = [marked] + [marked[i : i + n] for n in SIZES for i in range(len(marked) - n + 1)]
    mask = (1 << BITS) - 1
    return np.array([zlib.crc32(g.encode("utf-8", "surrogatepass")) & mask for g in grams], np.int64)


def counted(text: str) -> Counter:
    """The words of a text and how often each comes."""
    return Counter(_WORD.findall(text.lower()))


def bag(counts: dict[str, int], known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a document and their weights in its average."""
    for word in counts.keys() - known.keys():
        known[word] = buckets(word)
    if not counts:
        return np.zeros(1, np.int64), np.zeros(1)
    parts = [known[w] for w in counts]
    sizes = np.array([len(p) for p in parts])
    share = np.array(list(counts.values())) / sizes / sum(counts.values())
    places, back = np.unique(np.concatenate(parts), return_inverse=True)
    return places, np.bincount(back, np.repeat(share, sizes))


def train(texts: list[str], toxic: list[int], **rest) -> Model:
    return train_counts([counted(text) for text in texts], toxic, **rest)


def train_counts(
    documents: list[dict[str, int]], toxic: list[int], epochs: int = 12, rate: float = 0.2, decay: float = 1e-4, seed: int = 0
) -> Model:
    """Adagrad with weight decay on embeddings and softmax together, in batches of documents (words and their counts)."""
    labels = np.array(toxic, np.int64)
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return Model(np.zeros(1 << BITS, np.float32), 60.0 if share else -60.0)
    known: dict[str, np.ndarray] = {}
    bags, found = [], np.zeros(1 << BITS, np.int64)
    for counts in documents:
        if len(known) > 50_000:
            known.clear()
        places, shares = bag(counts, known)
        found[places] += 1
        bags.append((places.astype(np.int32), shares.astype(np.float32)))
    known.clear()
    kept = np.flatnonzero(found >= LEAST)
    row = np.full(1 << BITS, -1, np.int32)
    row[kept] = np.arange(len(kept))
    for i, (places, shares) in enumerate(bags):
        own = row[places]
        bags[i] = (own[own >= 0], shares[own >= 0]) if (own >= 0).any() else (np.zeros(1, np.int32), np.zeros(1, np.float32))
    random = np.random.default_rng(seed)
    embedding = random.normal(0, 0.1, (max(1, len(kept)), DIMENSIONS))
    softmax = random.normal(0, 0.1, (DIMENSIONS, 2))
    bias = np.log([1 - share, share])
    seen, seen_softmax, seen_bias = np.full(len(embedding), 1e-8), np.full(softmax.shape, 1e-8), np.full(2, 1e-8)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    for _ in range(epochs):
        order = random.permutation(len(bags))
        for at in range(0, len(order), 64):
            chosen = order[at : at + 64]
            places = np.concatenate([bags[i][0] for i in chosen])
            shares = np.concatenate([bags[i][1] for i in chosen])[:, None]
            sizes = [len(bags[i][0]) for i in chosen]
            mean = np.add.reduceat(embedding[places] * shares, np.cumsum([0, *sizes[:-1]]))
            logits = mean @ softmax + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(chosen)), labels[chosen]] -= 1
            p *= weight[chosen, None]
            slope = np.repeat(p @ softmax.T, sizes, 0) * shares
            unique, back = np.unique(places, return_inverse=True)
            summed = np.stack([np.bincount(back, slope[:, d]) for d in range(DIMENSIONS)], 1) + decay * embedding[unique]
            seen[unique] += (summed**2).mean(1)
            embedding[unique] -= rate * summed / np.sqrt(seen[unique])[:, None]
            slope_softmax, slope_bias = mean.T @ p, p.sum(0)
            seen_softmax += slope_softmax**2
            seen_bias += slope_bias**2
            softmax -= rate * slope_softmax / np.sqrt(seen_softmax)
            bias -= rate * slope_bias / np.sqrt(seen_bias)
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = (embedding @ (softmax[:, 1] - softmax[:, 0]))[: len(kept)]
    return Model(weights, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, sample_of_class: int = SAMPLE_OF_CLASS) -> Model:
    """Train on labelled documents; the caller has taken out of `labels` what must not be learned from.

    Each class keeps the labels whose hash of doc_id lies below sample_of_class / its size, so the sample is
    bounded at any input size and the same for equal input.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    own = own.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sizes = {row["toxic"]: row["n"] for row in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample_of_class / n))]) if sizes else None
    if share is None:
        return train([], [])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    chosen = own.where(draw < share[F.col("toxic")])
    rows = id_and_text(docs).join(F.broadcast(chosen), "doc_id").withColumnRenamed("toxic", "label")
    return trained(rows, counted, train_counts, train([], []))


def _scored(model: Model, texts: list[str]) -> list[float]:
    words, out = _scores(model), []
    for text in texts:
        found = _WORD.findall(text.lower())
        out.append(model.score(math.fsum(map(words.__getitem__, found)), len(found)))
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: dict[str, list]) -> dict[str, list]:
        return {"doc_id": rows["doc_id"], "score": _scored(shared.value, rows["text"])}

    return per_batch(id_and_text(docs), run, fields(docs, ("score", "double")))


def keep(docs: DataFrame, model: Model, below: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score lies below a threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return kept_rows(docs, lambda texts: [s < below for s in _scored(shared.value, texts)])


class _Words(dict):
    """Word to its score, for the words that a worker process has met."""

    def __init__(self, weights: np.ndarray, limit: int = 400_000):
        self.weights, self.limit = weights, limit

    def __missing__(self, word: str) -> float:
        out = float(self.weights[buckets(word)].mean(dtype=np.float64))
        if len(word) <= 48:
            if len(self) >= self.limit:
                self.clear()
            self[word] = out
        return out


_last: list = [None, None]


def _scores(model: Model) -> _Words:
    """The worker's scores under one model."""
    if _last[0] is not model:
        _last[:] = [model, _Words(model.weights)]
    return _last[1]
