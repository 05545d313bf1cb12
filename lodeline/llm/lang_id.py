"""Language of a text: a byte convolutional network, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.llm.common import LOWER, spans, utf8
from lodeline.llm.sampling import class_sample

#: Bytes of a window, filter widths, filters of each width.
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Labelled documents of each language to learn from at most (about), and windows of a document.
PER_CLASS = 500
WINDOWS = 6
CHUNK = 1 << 20

#: The network sees all 256 bytes, A-Z in lower case; 0 pads a window.
CLASSES = 256
#: Bytes of letters, by which windows vote: a-z and all above ASCII.
_LETTERS = np.zeros(256, bool)
_LETTERS[97:123] = _LETTERS[128:] = True

Params = dict[str, np.ndarray]


def windows(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts cut to windows of bytes, the last one padded with 0, and the text of each."""
    longs = np.diff(offsets)
    n = -(-longs // WINDOW)
    owner = np.repeat(np.arange(len(longs)), n)
    first = np.cumsum(n) - n
    out = np.zeros(int(n.sum()) * WINDOW, np.uint8)
    place = np.arange(len(buf)) + np.repeat(first * WINDOW - offsets[:-1], longs)
    out[place] = LOWER[buf]
    return out.reshape(-1, WINDOW), owner


class Network:
    """Filters as tables of bytes, max pooling over the window, a linear layer and softmax."""

    def __init__(self, params: Params, languages: list):
        self.params, self.languages = params, languages
        self.pairs = {}
        for w in WIDTHS:
            t = params[f"f{w}"]
            both = [np.add(t[k][:, None], t[k + 1][None, :]).reshape(CLASSES * CLASSES, FILTERS) for k in range(0, w - 1, 2)]
            self.pairs[w] = [np.ascontiguousarray(x, np.float32) for x in both]

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each window, at least 0."""
        x = x.astype(np.intp)
        pair = x[:, :-1] * CLASSES + x[:, 1:]
        out = []
        for w in WIDTHS:
            size = WINDOW - w + 1
            total = None
            for k, table in enumerate(self.pairs[w]):
                part = np.take(table, pair[:, 2 * k : 2 * k + size].ravel(), axis=0)
                total = part if total is None else np.add(total, part, out=total)
            if w % 2:
                total += np.take(self.params[f"f{w}"][w - 1], x[:, w - 1 : w - 1 + size].ravel(), axis=0)
            total = total.reshape(len(x), size * FILTERS)
            while size > 1:
                half = (size + 1) // 2
                np.maximum(total[:, : (size - half) * FILTERS], total[:, half * FILTERS : size * FILTERS], out=total[:, : (size - half) * FILTERS])
                size = half
            out.append(np.maximum(total[:, :FILTERS] + self.params[f"b{w}"], 0))
        return np.concatenate(out, axis=1)

    def log_softmax(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.params["w"] + self.params["c"]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def predict(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text the language's number and its probability: windows vote with the letters they hold."""
        x, owner = windows(buf, offsets)
        n = len(offsets) - 1
        votes = np.zeros((n, len(self.languages)))
        for i in range(0, len(x), 1024):
            part = x[i : i + 1024]
            weight = _LETTERS[part].sum(axis=1) / WINDOW
            np.add.at(votes, owner[i : i + 1024], np.exp(self.log_softmax(part)) * weight[:, None])
        total = votes.sum(axis=1)
        votes /= np.where(total > 0, total, 1)[:, None]
        best = votes.argmax(axis=1)
        return best, votes[np.arange(n), best]


def fit(x: np.ndarray, y: np.ndarray, languages: list, epochs: int = 6, batch: int = 64, rate: float = 0.004) -> Network:
    """Adam on the cross entropy; only the byte under each filter's largest response gets its gradient."""
    rng = np.random.default_rng(3)
    k = len(languages)
    p: Params = {f"f{w}": rng.normal(0, 0.2, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS}
    p |= {f"b{w}": np.zeros(FILTERS, np.float32) for w in WIDTHS}
    p |= {"w": rng.normal(0, 0.2, (FILTERS * len(WIDTHS), k)).astype(np.float32), "c": np.zeros(k, np.float32)}
    m = {n: np.zeros_like(v) for n, v in p.items()}
    v2 = {n: np.zeros_like(v) for n, v in p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            xb, yb = x[pick].astype(np.intp), y[pick]
            pooled, where = [], {}
            for w in WIDTHS:
                size = WINDOW - w + 1
                r = sum(p[f"f{w}"][j][xb[:, j : j + size]] for j in range(w))
                where[w] = r.argmax(axis=1)
                pooled.append(np.take_along_axis(r, where[w][:, None], 1)[:, 0] + p[f"b{w}"])
            a = np.concatenate(pooled, axis=1)
            h = np.maximum(a, 0)
            z = h @ p["w"] + p["c"]
            z -= z.max(axis=1, keepdims=True)
            d = np.exp(z)
            d /= d.sum(axis=1, keepdims=True)
            d[np.arange(len(pick)), yb] -= 1
            d /= len(pick)
            g = {"w": h.T @ d, "c": d.sum(axis=0)}
            back = (d @ p["w"].T) * (a > 0)
            for q, w in enumerate(WIDTHS):
                gw = back[:, q * FILTERS : (q + 1) * FILTERS]
                g[f"b{w}"] = gw.sum(axis=0)
                gf = np.zeros_like(p[f"f{w}"])
                for j in range(w):
                    np.add.at(gf[j], (np.take_along_axis(xb, where[w] + j, 1), np.arange(FILTERS)[None, :]), gw)
                g[f"f{w}"] = gf
            step += 1
            for n in p:
                m[n] = 0.9 * m[n] + 0.1 * g[n]
                v2[n] = 0.999 * v2[n] + 0.001 * g[n] ** 2
                p[n] = (p[n] - rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v2[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(p, languages)


def _windows_of(most: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column("text"))
            x, owner = windows(buf, offsets)
            n = np.bincount(owner, minlength=batch.num_rows)
            first = np.cumsum(n) - n
            take = np.concatenate([np.zeros(0, np.int64)] + [a + np.unique(np.linspace(0, c - 1, min(c, most)).astype(np.int64)) for a, c in zip(first, n) if c])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner[take])), batch.column("lang").take(pa.array(owner[take])), pa.array([r.tobytes() for r in x[take]], pa.binary())],
                ["doc_id", "lang", "window"],
            )

    return cut


def train(docs: DataFrame, per_class: int = PER_CLASS, per_text: int = WINDOWS) -> Network | None:
    """Learn from ``docs`` (doc_id, text, lang): a sample of about ``per_class`` of each language at most.

    Of each text in the sample up to ``per_text`` windows are learned from,
    spread over all of it. The sample, per_class * per_text windows a
    language, is the only thing that reaches the driver. None if no row has a
    text and a language. Repeated rows count as often as they come.
    """
    rows = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sample = class_sample(rows, "doc_id", "lang", per_class)
    got = sample.mapInArrow(_windows_of(per_text), "doc_id long, lang string, window binary").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("window", "ascending")])
    if not got.num_rows:
        return None
    languages = sorted(set(got.column("lang").to_pylist()))
    x = np.frombuffer(b"".join(got.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)
    y = np.array([languages.index(v) for v in got.column("lang").to_pylist()])
    # Windows that are cut short teach it what short texts look like.
    rng = np.random.default_rng(1)
    short = x.copy()
    short[np.arange(WINDOW)[None, :] >= rng.integers(12, 96, len(x))[:, None]] = 0
    return fit(np.concatenate((x, short)), np.concatenate((y, y)), languages)


def _predicting(model: Network | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        for batch in batches:
            n = batch.num_rows
            names: list = ["und"] * n
            scores = np.zeros(n)
            if model is not None:
                texts = batch.column("text")
                buf, offsets = utf8(texts)
                for i, j in spans(offsets, CHUNK):
                    best, sure = model.predict(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    for k in range(i, j):
                        if letter.search(texts[k].as_py() or ""):
                            names[k], scores[k] = model.languages[best[k - i]], min(1.0, float(sure[k - i]))
            keep = {c: batch.column(c) for c in batch.schema.names}
            keep |= {"lang_pred": pa.array(names, pa.string()), "lang_score": pa.array(scores)}
            yield pa.RecordBatch.from_arrays(list(keep.values()), list(keep))

    return predict


def predict(spark: SparkSession, docs: DataFrame, model: Network | None) -> DataFrame:
    """``docs`` (with a string column text) with lang_pred and lang_score.

    Every window of every text is scored; the windows' probabilities are
    averaged by the letters they hold; of equally likely languages the first
    in order of code points is named. Texts that are null or have no letter
    (Unicode L) get ``und`` and 0, as all do without a model. A text of any
    length is scored in chunks. Columns of ``docs`` with the two names are
    replaced; other columns and repeated rows stay as they are.
    """
    plain = docs.drop("lang_pred", "lang_score")
    schema = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return plain.mapInArrow(_predicting(model), schema)
