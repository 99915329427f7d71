"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Words (runs of letters, lower case, edges marked) give n-grams of 1 to 4 characters, hashed to buckets; a
document's features are their shares times their inverse document frequency in the training sample. The weights
are learned example by example by follow-the-regularised-leader with elastic-net penalties, which keeps most of
them exactly zero; a temperature fitted on training documents left aside calibrates the probabilities.

Features are linear in the words, so a worker keeps the summed weights of words that come again.

A null or empty text, or one without letters (numbers such as ½ or ² are none), is `und` with score 0. Very long texts
are judged whole; in training their words are counted before documents meet in one task. Null languages are not
learned; without any labelled document every text is `und`. Of equally likely languages the first by name is taken.
Equal texts, and so repeated rows, get equal results; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, id_and_text, per_batch, trained

#: Buckets of hashed n-grams (as a power of 2) and n-gram sizes.
BITS, SIZES = 18, (1, 2, 3, 4)

#: Training documents of each language, at most about so many, chosen by a hash of doc_id.
SAMPLE_OF_LANGUAGE = 1200

#: Runs of letters and of numbers other than digits (as in x²); only letters of them count, see `letters`.
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket x language, with the inverse document frequency in it
    bias: np.ndarray
    temperature: float

    def probabilities(self, total: np.ndarray, grams: float) -> np.ndarray:
        logits = (self.bias + total / max(grams, 1)) / self.temperature
        p = np.exp(logits - logits.max())
        return p / p.sum()


def letters(word: str) -> str:
    """The letters (Unicode categories L*) of a word."""
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def buckets(word: str) -> np.ndarray:
    word = letters(word)
    if not word:
        return np.zeros(0, np.int64)
    marked = f"<{word}>"
    mask = (1 << BITS) - 1
    grams = (marked[i : i + n] for n in SIZES for i in range(len(marked) - n + 1))
    return np.array([zlib.crc32(g.encode("utf-8", "surrogatepass")) & mask for g in grams], np.int64)


def counted(text: str) -> Counter:
    """The words of a text and how often each comes."""
    return Counter(_WORD.findall(text.lower()))


def shares(counts: dict[str, int], known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a document and their term frequencies; none if it has no letter."""
    for word in counts.keys() - known.keys():
        known[word] = buckets(word)
    parts = [known[w] for w in counts]
    if not sum(map(len, parts)):
        return np.zeros(0, np.int64), np.zeros(0)
    places, back = np.unique(np.concatenate(parts), return_inverse=True)
    tf = np.bincount(back, np.repeat(np.array(list(counts.values()), float), [len(p) for p in parts]))
    return places, tf / tf.sum()


def train(texts: list[str], languages: list[str], **rest) -> Model:
    return train_counts([counted(text) for text in texts], languages, **rest)


def train_counts(
    documents: list[dict[str, int]],
    languages: list[str],
    alpha: float = 2.0,
    beta: float = 1.0,
    l1: float = 2e-4,
    l2: float = 1e-4,
    epochs: int = 3,
    seed: int = 0,
) -> Model:
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    known: dict[str, np.ndarray] = {}
    bags, target, found = [], [], np.zeros(1 << BITS)
    for counts, language in zip(documents, languages, strict=True):
        if len(known) > 50_000:
            known.clear()
        places, tf = shares(counts, known)
        if len(places):
            found[places] += 1
            bags.append((places.astype(np.int32), tf.astype(np.float32)))
            target.append(names.index(language))
    idf = np.log((1 + len(bags)) / (1 + found)) + 1
    k, random = len(names), np.random.default_rng(seed)
    z, n, bias = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k)), np.zeros(k)

    def solved(places: np.ndarray) -> np.ndarray:
        """The leader's weights: zero where the summed slope stays within the first penalty."""
        own = z[places]
        out = -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[places])) / alpha + l2)
        out[np.abs(own) <= l1] = 0
        return out

    order = random.permutation(len(bags))
    aside, order = order[: len(order) // 8], order[len(order) // 8 :]
    for _ in range(epochs):
        for i in random.permutation(order):
            places, tf = bags[i]
            x = tf * idf[places]
            w = solved(places)
            p = np.exp(np.clip(bias + x @ w, -50, 50))
            p /= p.sum()
            p[target[i]] -= 1
            slope = x[:, None] * p
            sigma = (np.sqrt(n[places] + slope**2) - np.sqrt(n[places])) / alpha
            z[places] += slope - sigma * w
            n[places] += slope**2
            bias -= 0.05 * p
    weights = solved(np.arange(1 << BITS))
    weights *= idf[:, None]
    temperature = 1.0
    if len(aside):
        logits = np.array([bias + bags[i][1] @ weights[bags[i][0]] for i in aside])
        truth = np.array([target[i] for i in aside])

        def loss(t: float) -> float:
            own = logits / t
            top = own.max(1, keepdims=True)
            return float((top[:, 0] + np.log(np.exp(own - top).sum(1)) - own[np.arange(len(own)), truth]).mean())

        temperature = float(min(np.geomspace(0.05, 10, 120), key=loss))
    return Model(names, weights.astype(np.float32), bias, temperature)


def fit(labelled: DataFrame, sample_of_language: int = SAMPLE_OF_LANGUAGE) -> Model:
    """Train on documents with a language (column lang); the caller has taken out what must not be learned from.

    The languages' sizes come from all rows; each keeps the documents whose hash of doc_id lies below
    sample_of_language / its size, so the sample is bounded for a given set of languages.
    """
    own = labelled.where(F.col("lang").isNotNull())
    sizes = {row["lang"]: row["n"] for row in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return train([], [])
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample_of_language / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    rows = own.where(draw < share[F.col("lang")])
    rows = rows.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("lang").alias("label"))
    return trained(rows, counted, train_counts, train([], []))


class _Words(dict):
    """Word to the row of `sums` with its summed weights and number of n-grams, for words that a worker has met."""

    def __init__(self, weights: np.ndarray, limit: int = 300_000):
        self.weights, self.limit = weights, limit
        self.sums = np.zeros((limit, weights.shape[1] + 1))

    def __missing__(self, word: str) -> int:
        own, row = buckets(word), len(self)
        self.sums[row, :-1] = self.weights[own].sum(0, dtype=np.float64)
        self.sums[row, -1] = len(own)
        self[word] = row
        return row

    def total(self, words: list[str]) -> np.ndarray:
        """The sum of the words' rows. All is forgotten before a document that might not fit."""
        if len(self) + len(words) > len(self.sums):
            self.clear()
            if len(words) > len(self.sums) or len(self.sums) > self.limit:
                self.sums = np.zeros((max(self.limit, len(words)), self.sums.shape[1]))
        return self.sums[np.fromiter(map(self.__getitem__, words), np.int64, len(words))].sum(0)


_last: list = [None, None]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: dict[str, list]) -> dict[str, list]:
        own = shared.value
        if _last[0] is not own:
            _last[:] = [own, _Words(own.weights)]
        words, names, scores = _last[1], [], []
        for text in rows["text"]:
            found = _WORD.findall(text.lower())
            total = words.total(found) if found and own.languages else None
            if total is None or not total[-1]:
                names.append("und")
                scores.append(0.0)
                continue
            p = own.probabilities(total[:-1], total[-1])
            best = int(p.argmax())
            names.append(own.languages[best])
            scores.append(float(p[best]))
        return {"doc_id": rows["doc_id"], "lang_pred": names, "score": scores}

    return per_batch(id_and_text(docs), run, fields(docs, ("lang_pred", "string"), ("score", "double")))
