"""Quality score: hashed word n-grams, logistic regression by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm.common import LOWER, hash_spans, mix64, spans, utf8, words_of
from lodeline.llm.sampling import class_sample

#: Hash buckets of features, and labelled documents of each class to learn from at most (about).
BUCKETS = 1 << 18
PER_CLASS = 1500
CHUNK = 2 << 20

#: Kinds of bytes in a word's outline: other, a-z, A-Z, digit, above ASCII; punctuation stands for itself.
_OUTLINE = np.zeros(256, np.uint8)
_OUTLINE[33:127] = np.arange(33, 127)
_OUTLINE[97:123] = 1
_OUTLINE[65:91] = 2
_OUTLINE[48:58] = 3
_OUTLINE[128:] = 1


def _outlines(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word with runs of one kind of byte drawn together, such as Aa, A!! or a%%%."""
    kinds = _OUTLINE[buf]
    same = np.zeros(len(buf), bool)
    same[1:] = (kinds[1:] == kinds[:-1]) & (kinds[1:] <= 3)
    same[starts] = False
    kept = ~same
    place = np.concatenate(([0], np.cumsum(kept)))
    return hash_spans(kinds[kept], place[starts], place[ends])


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all n-grams of some texts, and where each text's begin.

    For each word: the word, the word and its predecessor, its outline, the
    outlines of it and its predecessor, and whether it repeats its predecessor
    or the word before that. All are hashed into the same buckets.
    """
    starts, ends, counts = words_of(buf, offsets)
    first = np.cumsum(counts) - counts
    words = hash_spans(LOWER[buf], starts, ends)
    shapes = _outlines(buf, starts, ends)
    back = np.empty_like(words)
    back_shape = np.empty_like(words)
    back[1:], back_shape[1:] = words[:-1], shapes[:-1]
    begins = first[counts > 0]
    back[begins] = back_shape[begins] = 0
    again = np.zeros(len(words), np.uint64)
    again[1:] += words[1:] == words[:-1]
    again[2:] += np.uint64(2) * (words[2:] == words[:-2]).astype(np.uint64)
    again[begins] = 0
    grams = np.empty((len(words), 5), np.uint64)
    for k, x in enumerate((words, words * np.uint64(3) + back, shapes, shapes * np.uint64(3) + back_shape, again)):
        grams[:, k] = mix64(x + np.uint64((k + 1) * 0xA24BAED4963EE407 % 2**64))
    ids = (grams % np.uint64(BUCKETS)).astype(np.int64).ravel()
    return ids, np.append(first, len(words)) * 5


class Model:
    """Weights of the buckets and a bias. A text's score is the logistic of its mean weight, scaled, plus the bias."""

    def __init__(self, weights: np.ndarray, bias: float, scale: float):
        self.weights, self.bias, self.scale = weights, bias, scale

    def scores(self, ids: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(self.weights[ids], dtype=np.float64)))
        n = np.maximum(np.diff(firsts), 1)
        z = self.scale * (total[firsts[1:]] - total[firsts[:-1]]) / n + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def fit(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 4, scale: float = 20.0,
        alpha: float = 0.1, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> Model:
    """FTRL-proximal over examples (distinct buckets, their shares in the text), a fixed random order for each epoch."""
    n, z, w = (np.zeros(BUCKETS + 1) for _ in range(3))
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            ids, shares = examples[k]
            i = np.append(ids, BUCKETS)
            x = np.append(shares * scale, 1.0)
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -35, 35)))
            g = (p - labels[k]) * x
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[i] = zi + g - step * wi
            n[i] = ni + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return Model(w[:BUCKETS].astype(np.float32), float(w[BUCKETS]), scale)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = utf8(batch.column("text"))
        found, shares = [], []
        for i, j in spans(offsets, CHUNK):
            ids, firsts = features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for a, b in zip(firsts[:-1], firsts[1:]):
                own, counts = np.unique(ids[a:b], return_counts=True)
                found.append(own.astype("<i4").tobytes())
                shares.append((counts / max(b - a, 1)).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary()), pa.array(shares, pa.binary())],
            ["doc_id", "label", "ids", "shares"],
        )


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """Learn from ``labels`` (doc_id, label 0/1) and the whole texts of ``docs`` (doc_id, text).

    The labels are a sample of at most about ``per_class`` rows of each class,
    which bounds what is broadcast and what reaches the driver. None without
    any labelled document.
    """
    known = labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    sample = class_sample(known, "doc_id", "label", per_class)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    got = rows.mapInArrow(_sparse, "doc_id long, label int, ids binary, shares binary").toArrow().sort_by([("doc_id", "ascending")])
    if not got.num_rows:
        return None
    examples = [(np.frombuffer(a.as_py(), "<i4"), np.frombuffer(b.as_py(), "<f4")) for a, b in zip(got.column("ids"), got.column("shares"))]
    return fit(examples, got.column("label").to_numpy().astype(float))


def _scoring(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column("text"))
            out = [np.zeros(0)]
            for i, j in spans(offsets, CHUNK):
                out.append(model.scores(*features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out))], ["doc_id", "score"])

    return score


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``, learnt from ``labels`` (doc_id, label).

    The score, from 0 to 1, is the higher the likelier label 1 is. Null texts
    count as empty; an empty text's score comes from the bias. Labels other
    than 0 and 1 are left out, of several labels for an id the largest counts.
    Without labels every score is 0.5. The model's size is fixed by BUCKETS.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(ids, labels, per_class) or Model(np.zeros(BUCKETS, np.float32), 0.0, 1.0)
    scored = ids.mapInArrow(_scoring(model), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
