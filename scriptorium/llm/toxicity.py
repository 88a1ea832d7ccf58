"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence has the probability sigmoid(bias + weights of its distinct hashed words and stems); a document, by noisy-or, one minus the product
of its sentences' complements. Weights are trained from document labels alone, so the sentences that carry a label are found
by the training, and scoring returns their spans.

Training takes at most TRAIN labelled documents (the least by a hash of doc_id) of at most TRAIN_BYTES each, gathered as hashed
features; scoring takes every whole text. Inputs are texts only. Null and empty texts have no sentence and score 0. Rows without
doc_id are scored and count as not held out; repeated rows each give their row, and train by the least of their texts; conflicting labels count as 1. Without labels
of both kinds every score is 0. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import by_batch, least_by_hash

TRAIN, TRAIN_BYTES, SLOTS = 6000, 20_000, 1 << 18
#: Letters of a word that are a feature besides the word.
STEMS = (4, 5)
STEPS, RATE, DECAY, LEAST_DOCS = 150, 0.3, 7e-5, 5

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"\w+")


class _Slots(dict):
    """Slots of a word: the word itself, and its first letters, which inflected forms share."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        parts = [word, *("^" + word[:n] for n in STEMS if len(word) > n)]
        found = tuple(xxhash.xxh64_intdigest(p) % SLOTS for p in parts)
        if len(self) > 500_000:
            self.clear()
        self[word] = found
        return found


_slots = _Slots()


def sentences(text: str | None) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Spans of the sentences that have words, and the distinct slots of each."""
    spans, slots = [], []
    for m in _SENTENCE.finditer(text or ""):
        words = _WORD.findall(m[0].lower())
        if words:
            spans.append(m.span())
            slots.append(np.fromiter({x for w in words for x in _slots[w]}, np.int32))
    return spans, slots


def train(bags: list[list[np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Weights by slot, the bias last. Full-batch Adam on the likelihood of noisy-or; the same input gives the same weights."""
    weights = np.zeros(SLOTS + 1)
    weights[-1] = -30.0
    if not len(labels) or labels.min() == labels.max():
        return weights
    flat = np.concatenate([s for b in bags for s in b])
    size = np.array([len(s) for b in bags for s in b])
    of_doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    of_sentence = np.repeat(np.arange(len(size)), size)
    # words of few documents could only learn single labels by heart
    seen = np.unique(of_doc[of_sentence].astype(np.int64) * SLOTS + flat)
    common = np.bincount(seen % SLOTS, minlength=SLOTS) >= LEAST_DOCS
    kept = common[flat]
    used, flat = np.unique(flat[kept], return_inverse=True)
    of_sentence = of_sentence[kept]
    w, bias = np.zeros(len(used)), -6.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    y = labels.astype(float)
    for step in range(1, STEPS + 1):
        z = np.bincount(of_sentence, weights=w[flat], minlength=len(size)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        none = np.bincount(of_doc, weights=-np.logaddexp(0, z), minlength=len(bags))  # log of the product of complements
        any_ = np.maximum(-np.expm1(none), 1e-9)
        pull = np.where(y == 1, -np.exp(none) / any_, 1.0)
        g = pull[of_doc] * p / len(bags)
        grad = np.append(np.bincount(flat, weights=g[of_sentence], minlength=len(used)) + DECAY * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weights[used] = w
    weights[-1] = bias
    return weights


def score(text: str | None, weights: np.ndarray, least: float = 0.5) -> tuple[float, list[dict]]:
    """Probability of a whole text, and the sentences with at least `least` of their own."""
    spans, slots = sentences(text)
    if not spans:
        return 0.0, []
    at = np.cumsum([0, *(len(s) for s in slots)])[:-1]
    z = np.add.reduceat(weights[np.concatenate(slots)], at) + weights[-1]
    none = float(-np.logaddexp(0, z).sum())
    p = 1 / (1 + np.exp(-z))
    return float(-np.expm1(none)), [{"start": spans[i][0], "end": spans[i][1], "p": float(p[i])} for i in np.flatnonzero(p >= least).tolist()]


def _bagged(columns: dict) -> dict:
    bags = [sentences(t)[1] for t in columns.pop("text")]
    return columns | {"slots": [np.concatenate(b).tobytes() if b else b"" for b in bags], "sizes": [np.array([len(s) for s in b], np.int32).tobytes() for b in bags]}


_BAG = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("slots", T.BinaryType()), T.StructField("sizes", T.BinaryType())])


def fold(doc_id: str) -> Column:
    """crc32 of doc_id as text, modulo 5. Fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string")) % 5


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights of a model trained on all training folds, and set right by calibrated()."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id") != 0))
    known = least_by_hash(known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), TRAIN, "doc_id")
    # TRAIN rows of two numbers: a bounded table
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= TRAIN_BYTES).join(F.broadcast(known), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # one text of a repeated doc_id
    rows = sorted((r.doc_id, r.toxic, bytes(r.slots), bytes(r.sizes)) for r in by_batch(texts, _BAG, _bagged).collect())
    bags = [np.split(np.frombuffer(s, np.int32), np.cumsum(np.frombuffer(n, np.int32))[:-1]) if n else [] for _, _, s, n in rows]
    y = np.array([r[1] for r in rows])
    out = np.array([zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows], bool)
    weights = train(bags, y)
    part = train([b for b, o in zip(bags, out, strict=True) if not o], y[~out])
    scale, shift = calibrated([b for b, o in zip(bags, out, strict=True) if o], y[out], part)
    weights = weights * scale
    weights[-1] += shift
    return weights


def calibrated(bags: list[list[np.ndarray]], labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the log-odds of sentences under which noisy-or makes the labels of documents that training left out
    likeliest: a score is then the probability of the label, and 0.5 makes the fewest errors. Without both labels: 1, 0."""
    if not len(labels) or labels.min() == labels.max():
        return 1.0, 0.0
    of_doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    z = np.array([weights[s].sum() + weights[-1] for b in bags for s in b])

    def loss(scale: float, shift: float) -> float:
        none = np.bincount(of_doc, weights=-np.logaddexp(0, scale * z + shift), minlength=len(bags))
        toxic = np.log(np.maximum(-np.expm1(none), 1e-9))
        return -float(np.where(labels == 1, toxic, none).mean())

    return min(((a, b) for a in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0) for b in np.arange(-12, 12.01, 0.25)), key=lambda x: (loss(*x), abs(x[0] - 1), abs(x[1])))


_SCORE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])))])


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score and offending: start, end and probability of sentences that are toxic by themselves. No shuffle.

    The weights are SLOTS + 1 numbers (2 MB), whatever the input."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def work(columns: dict) -> dict:
        made = [score(t, shared.value) for t in columns["text"]]
        return columns | {"score": [x[0] for x in made], "offending": [x[1] for x in made]}

    return by_batch(docs.select("doc_id", "text"), _SCORE, work)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs, fit(docs, labels))
    held = F.coalesce(fold("doc_id") == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
