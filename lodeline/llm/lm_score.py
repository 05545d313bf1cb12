"""Language-model score: hashed maximum entropy with n-gram and skip features and class-factored softmax."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm.common import LOWER, hash_spans, mix64, new_path, spans, staged, utf8, words_of

#: Words with a symbol of their own (the end of a text is the first), in groups; classes of all other words.
HEAD, GROUP, RARE = 1024, 32, 64
GROUPS = HEAD // GROUP
CLASSES = GROUPS + RARE
SYMBOLS = HEAD + RARE + 1
START = HEAD + RARE
#: Buckets of each pair of context symbols, of the class's features, and of those within a group.
PAIRS = 2048
FEATURES = 3 * SYMBOLS + 2 * PAIRS
INNER = 1 << 14
#: Most frequent words whose counts go to all tasks (12 bytes each); the counts of all others are joined.
TABLE = 1 << 18
#: Training: rounds over disjoint parts of the texts, which together hold all of them, positions of a step, rate.
ROUNDS, TRAIN_STEP, RATE = 3, 8192, 0.6
#: Positions scored at once, rows of a stretch of a gradient that are summed in turn, and rows worked on at once, which stay in the processor's cache.
STEP, PACK, NEAR = 2048, 32, 512
#: Logits beyond which float32 exponentials, or sums of them, may overflow or vanish.
FAR = 60.0
CHUNK = 4 << 20
_END = np.uint64(0x5EED0E0F0E0D5EED)


def _rare_class(buf: np.ndarray, ends: np.ndarray, longs: np.ndarray) -> np.ndarray:
    """A word's class by its last two bytes, for words without a symbol."""
    last = buf[ends - 1].astype(np.uint64)
    before = np.where(longs > 1, buf[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
    return (mix64(before * np.uint64(256) + last) % np.uint64(RARE)).astype(np.int64)


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and rare classes of all words, and how many each text has."""
    low = LOWER[buf]
    starts, ends, counts = words_of(low, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), counts
    return hash_spans(low, starts, ends), _rare_class(low, ends, ends - starts), counts


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n, cls): a count of each word for each stretch of texts; an end for each text."""
    import pandas as pd

    for batch in batches:
        buf, offsets = utf8(batch.column("text"))
        yield _counts(np.array([_END]), np.array([batch.num_rows]), np.zeros(1, np.int64))
        for i, j in spans(offsets, 2 * CHUNK):
            hashes, cls, _ = _tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            codes, distinct = pd.factorize(hashes)
            kinds = np.zeros(len(distinct), np.int64)
            kinds[codes] = cls
            yield _counts(distinct, np.bincount(codes, minlength=len(distinct)), kinds)


def _counts(h: np.ndarray, n: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(cls.astype(np.int32))], ["h", "n", "cls"])


@dataclass
class Vocabulary:
    """Counts of all training words, as far as tasks need them."""

    total: int
    distinct: int
    keys: np.ndarray  # sorted hashes of the most frequent words, TABLE at most
    counts: np.ndarray
    symbols: np.ndarray  # their symbols, -1 for those in rare classes
    end: int  # count of the end
    masses: np.ndarray  # for each rare class its words' counts, each and an unknown word one more
    head_counts: np.ndarray = field(default_factory=lambda: np.zeros(HEAD))

    @property
    def floor(self) -> float:
        return math.log10(self.total + self.distinct + 1)


def _cut(counts: DataFrame) -> int:
    """The least count that no more than TABLE words reach, from the numbers of words between steps of a sixteenth of a power of two."""
    step = F.ceil(F.log2(F.col("c").cast("double")) * 16)
    words = {r[0]: r[1] for r in counts.groupBy(step.alias("step")).count().collect()}
    total, least = 0, max(words, default=0) + 1
    for k in sorted(words, reverse=True):
        total += words[k]
        if total > TABLE:
            break
        least = k
    return math.floor(2 ** ((least - 1) / 16) + 1e-6) + 1 if least > 0 else 1


def vocabulary(counts: DataFrame) -> Vocabulary:
    row = counts.agg(F.sum("c"), F.count("*")).first()
    per_class = counts.where(F.col("h") != F.lit(int(_END.view(np.int64)))).groupBy("cls").agg(F.sum(F.col("c") + 1)).collect()
    masses = np.ones(RARE)
    for cls, mass in per_class:
        masses[cls] += int(mass)
    top = counts.where(F.col("c") >= _cut(counts)).toArrow()
    h, c, cls = (top.column(k).to_numpy() for k in ("h", "c", "cls"))
    order = np.lexsort((h, -c))
    h, c, cls = h[order].view(np.uint64), c[order].astype(np.int64), cls[order]
    is_end = h == _END
    end = int(c[is_end].sum())
    h, c, cls = h[~is_end], c[~is_end], cls[~is_end]
    symbols = np.full(len(h), -1, np.int64)
    own = min(HEAD - 1, len(h))
    symbols[:own] = np.arange(1, own + 1)
    np.subtract.at(masses, cls[:own], c[:own] + 1)
    head = np.zeros(HEAD)
    head[0], head[1 : own + 1] = end, c[:own]
    by_hash = np.argsort(h)
    return Vocabulary(int(row[0] or 0), int(row[1]), h[by_hash], c[by_hash], symbols[by_hash], end, masses, head)


_ENCODED = "doc_id long, held_out boolean, fold int, n_tokens long, symbols binary, known long, base double, rare double, missing array<long>"


def _encoding(v: Vocabulary):
    """Symbols of each text and what its words contribute to both scores; hashes of words that aren't in the table."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        gain = np.log10(v.counts + 1)
        class_cost = np.log10(v.masses)
        end_symbol = 0 if v.end else HEAD
        end_base = math.log10(v.end + 1)
        end_rare = 0.0 if v.end else -float(class_cost[0])
        for batch in batches:
            buf, offsets = utf8(batch.column("text"))
            for i, j in spans(offsets, CHUNK):
                hashes, cls, counts = _tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                codes, distinct = pd.factorize(hashes)
                at = np.minimum(np.searchsorted(v.keys, distinct), max(len(v.keys) - 1, 0))
                hit = v.keys[at] == distinct if len(v.keys) else np.zeros(len(distinct), bool)
                at = np.where(hit, at, 0)
                found = hit[codes]
                own = np.where(hit, v.symbols[at], -1)[codes] if len(v.keys) else np.full(len(codes), -1)
                log_count = np.where(hit, gain[at], 0.0)[codes] if len(v.keys) else np.zeros(len(codes))
                symbol = np.where(own >= 0, own, HEAD + cls)
                in_rare = np.where(own >= 0, 0.0, log_count - class_cost[cls])
                ends = np.cumsum(counts)
                add = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], ends))])
                with_ends = np.insert(symbol, ends, end_symbol).astype("<u2")
                cuts = np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))
                raw = with_ends.tobytes()
                lost = ~found
                lost_cuts = np.concatenate(([0], np.cumsum(add(lost)))).astype(np.int32)
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"), rows.column("held_out"), rows.column("fold"), pa.array(counts + 1),
                        pa.array([raw[2 * a : 2 * b] for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                        pa.array(add(found.astype(np.int64)) + int(v.end > 0)), pa.array(add(log_count) + end_base), pa.array(add(in_rare) + end_rare),
                        pa.ListArray.from_arrays(pa.array(lost_cuts), pa.array(hashes[lost].view(np.int64))),
                    ],
                    ["doc_id", "held_out", "fold", "n_tokens", "symbols", "known", "base", "rare", "missing"],
                )

    return encode


class Model:
    """Weights of the classes' features and of those within groups; the biases come from the counts."""

    def __init__(self, v: Vocabulary):
        self.outer = np.zeros((FEATURES, CLASSES), np.float32)
        self.inner = np.zeros((INNER, GROUP), np.float32)
        head = v.head_counts.reshape(GROUPS, GROUP)
        mass = np.concatenate(((head + (head > 0)).sum(axis=1), v.masses))
        with np.errstate(divide="ignore"):
            self.outer_bias = np.maximum(np.log(mass / max(mass.sum(), 1)), -1e4).astype(np.float32)
            self.inner_bias = np.maximum(np.log(head + (head > 0)), -1e4).astype(np.float32)

    def values(self) -> np.ndarray:
        return np.concatenate((self.outer.ravel(), self.inner.ravel()))

    def assign(self, flat: np.ndarray) -> None:
        self.outer = flat[: FEATURES * CLASSES].reshape(FEATURES, CLASSES)
        self.inner = flat[FEATURES * CLASSES :].reshape(INNER, GROUP)

    def outer_logits(self, rows: np.ndarray) -> np.ndarray:
        return _row_sums(self.outer, rows, self.outer_bias)

    def inner_logits(self, rows: np.ndarray, group: np.ndarray) -> np.ndarray:
        z = _row_sums(self.inner, rows)
        z += self.inner_bias.take(group, axis=0)
        return z


def _row_sums(weights: np.ndarray, rows: np.ndarray, start: np.ndarray | float = 0) -> np.ndarray:
    """For each position the sum of its rows of the weights and of ``start``."""
    columns = np.ascontiguousarray(rows.T)
    out, spare = np.empty((len(rows), weights.shape[1]), weights.dtype), np.empty((NEAR, weights.shape[1]), weights.dtype)
    for i in range(0, len(rows), NEAR):
        z = out[i : i + NEAR]
        weights.take(columns[0, i : i + NEAR], axis=0, out=z, mode="clip")
        for column in columns[1:]:
            z += weights.take(column[i : i + NEAR], axis=0, out=spare[: len(z)], mode="clip")
        z += start
    return out


def contexts(symbols: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Feature rows of each position: the symbol before, those two and three back, and two pairs of them."""
    back = []
    for d in (1, 2, 3):
        s = np.empty(len(symbols), np.int64)
        s[:d] = START
        s[d:] = symbols[:-d] if d < len(symbols) else symbols[:0]
        for k in range(d):
            at = firsts + k
            s[at[at < len(symbols)]] = START
        back.append(s)
    # A text may be shorter than the offset, so that an earlier text's symbols would show.
    place = np.arange(len(symbols)) - np.repeat(firsts, np.diff(np.append(firsts, len(symbols))))
    for d in (2, 3):
        back[d - 1][place < d] = START
    one, two, three = back
    pair = lambda a, b, k: (mix64((a * SYMBOLS + b + k * SYMBOLS * SYMBOLS).astype(np.uint64)) % np.uint64(PAIRS)).astype(np.int64)
    return np.stack(
        (one, SYMBOLS + two, 2 * SYMBOLS + three, 3 * SYMBOLS + pair(one, two, 1), 3 * SYMBOLS + PAIRS + pair(one, three, 2)), axis=1
    )


def inner_rows(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    return (mix64((rows * GROUPS + group[:, None]).astype(np.uint64)) % np.uint64(INNER)).astype(np.int64)


def _classes(symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols < HEAD, symbols // GROUP, symbols - HEAD + GROUPS)


def _exponentials(z: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Turns logits into exponentials, some rows at a time: they, their sums, and the logits at ``y``.

    Only where a logit is far from zero, each row's greatest is taken off first.
    """
    one, places = np.ones(z.shape[1], z.dtype), np.arange(NEAR)
    for i in range(0, len(z), NEAR):
        e = z[i : i + NEAR]
        if max(e.max(), -e.min()) > FAR:
            e -= e.max(axis=1, keepdims=True)
        at = e[places[: len(e)], y[i : i + NEAR]]
        yield np.exp(e, out=e), e @ one, at


def _log_softmax_at(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([at - np.log(total) for _, total, at in _exponentials(z, y)])


def log_probabilities(model: Model, symbols: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each position's class, and of the word in its group."""
    out = np.zeros(len(symbols))
    rows, classes = contexts(symbols, firsts), _classes(symbols)
    for i in range(0, len(symbols), STEP):
        r, c, s = rows[i : i + STEP], classes[i : i + STEP], symbols[i : i + STEP]
        part = _log_softmax_at(model.outer_logits(r), c).astype(np.float64)
        own = np.flatnonzero(s < HEAD)
        if len(own):
            part[own] += _log_softmax_at(model.inner_logits(inner_rows(r[own], c[own]), c[own]), s[own] % GROUP)
        out[i : i + STEP] = part
    return out


def _segment_sums(x: np.ndarray, fresh: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Sums of the stretches of rows (of ``x``, in this order if given) that begin where ``fresh`` is true.

    Stretches are cut into pieces of PACK rows. The first rows of all pieces
    are added to the second ones, then the third ones of those that have one,
    and so on, the longest pieces first. Each row is so read and added once;
    the sums of a stretch's pieces are then summed the same way.
    """
    if order is None:
        order = np.arange(len(x))
    first = np.flatnonzero(fresh)
    longs = np.diff(np.append(first, len(fresh)))
    pieces = -(-longs // PACK)
    past = PACK * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    starts, sizes = np.repeat(first, pieces) + past, np.minimum(np.repeat(longs, pieces) - past, PACK)
    by = np.argsort((PACK - sizes).astype(np.uint16), kind="stable")
    starts, reach = starts[by], np.cumsum(np.bincount(sizes, minlength=PACK + 1)[::-1])[::-1].tolist()
    out, spare = x.take(order[starts], axis=0), np.empty((NEAR, x.shape[1]), x.dtype)
    for k in range(1, int(sizes.max())):
        for i in range(0, reach[k + 1], NEAR):
            j = min(i + NEAR, reach[k + 1])
            out[i:j] += x.take(order[starts[i:j] + k], axis=0, out=spare[: j - i], mode="clip")
    back = np.empty(len(by), np.int64)
    back[by] = np.arange(len(by))
    return out.take(back, axis=0) if len(by) == len(first) else _segment_sums(out, past == 0, back)


def _descend(weights: np.ndarray, seen: np.ndarray, rows: np.ndarray, z: np.ndarray, y: np.ndarray) -> None:
    """One AdaGrad step on the cross entropy of some positions; ``seen`` sums each row's squared gradients."""
    for e, total, _ in _exponentials(z, y):
        e /= total[:, None]
    z[np.arange(len(y)), y] -= 1
    flat = rows.T.ravel().astype(np.uint16)  # two bytes are sorted by radix
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    fresh = np.append(True, ranked[1:] != ranked[:-1])
    gradient = _segment_sums(z, fresh, order % len(y))
    ids = ranked[fresh]
    seen[ids] += np.einsum("ij,ij->i", gradient, gradient)
    gradient *= (RATE / np.sqrt(seen[ids] + 1.0))[:, None]
    weights[ids] = weights.take(ids, axis=0) - gradient


def _positions(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    flat = batch.column("symbols").to_numpy(zero_copy_only=False)
    longs = np.array([len(x) // 2 for x in flat])
    return np.frombuffer(b"".join(flat), "<u2").astype(np.int64), np.cumsum(longs) - longs


#: Values of a block of the model, as tasks send it.
BLOCK = 1 << 14


def _training(model: Model):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        own.outer_bias, own.inner_bias = model.outer_bias, model.inner_bias
        own.outer, own.inner = model.outer.copy(), model.inner.copy()
        seen_outer, seen_inner = np.zeros(FEATURES, np.float32), np.zeros(INNER, np.float32)
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                symbols, firsts = _positions(part)
                if not len(symbols):
                    continue
                rows, classes = contexts(symbols, firsts), _classes(symbols)
                for i in range(0, len(symbols), TRAIN_STEP):
                    r, c, s = rows[i : i + TRAIN_STEP], classes[i : i + TRAIN_STEP], symbols[i : i + TRAIN_STEP]
                    _descend(own.outer, seen_outer, r, own.outer_logits(r), c)
                    head = np.flatnonzero(s < HEAD)
                    if len(head):
                        inner = inner_rows(r[head], c[head])
                        _descend(own.inner, seen_inner, inner, own.inner_logits(inner, c[head]), s[head] % GROUP)
                n += len(symbols)
        if n:
            change = (own.values() - model.values()).astype(np.float16)
            blocks = [change[i : i + BLOCK].tobytes() for i in range(0, len(change), BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(blocks))), pa.array(np.full(len(blocks), n)), pa.array(blocks, pa.binary())], ["block", "n", "change"]
            )

    return train


def _averaging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of all tasks' changes of a block, by their positions, one row at a time."""
    now, total, weight = -1, None, 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([(total / weight).astype("<f4").tobytes()], pa.binary())], ["block", "change"])

    for batch in batches:
        for block, n, change in zip(batch.column("block").to_pylist(), batch.column("n").to_pylist(), batch.column("change")):
            if block != now:
                if total is not None:
                    yield done()
                now, total, weight = block, 0.0, 0
            total = total + np.frombuffer(change.as_py(), np.float16).astype(np.float64) * n
            weight += n
    if total is not None:
        yield done()


def train(encoded: DataFrame, model: Model, rounds: int = ROUNDS) -> None:
    """Rounds of gradient updates; each has its own part of the texts, and each task starts from the model so far.

    Tasks send what they changed in blocks; a block's changes are averaged
    where it is dealt to, and only the averages, the size of one model, reach
    the driver.
    """
    for k in range(rounds):
        changes = encoded.where(F.col("fold") == k).select("doc_id", "symbols").mapInArrow(_training(model), "block long, n long, change binary")
        means = changes.repartition("block").sortWithinPartitions("block").mapInArrow(_averaging, "block long, change binary").toArrow().sort_by("block")
        if means.num_rows:
            model.assign(model.values() + np.concatenate([np.frombuffer(b.as_py(), "<f4") for b in means.column("change")]))


def _scoring(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for at in range(0, batch.num_rows, 512):
                symbols, firsts = _positions(batch.slice(at, 512))
                if len(symbols):
                    out[at : at + 512] = np.add.reduceat(log_probabilities(model, symbols, firsts), firsts) / math.log(10)
            keep = [batch.column(c) for c in ("uid", "doc_id", "held_out", "n_tokens", "known", "base", "rare")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(out)], ["uid", "doc_id", "held_out", "n_tokens", "known", "base", "rare", "log_p"])

    return score


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text, held_out).

    Learns from rows whose ``held_out`` is false. A text's tokens are its
    words in lower case (A-Z only) and one end. ``base_score`` sums
    log10((c + 1) / (N + V + 1)) over the tokens; ``score`` is the model's:
    for each token the class's probability given the three tokens before, and
    the word's within its class. Frequent words are in classes of 32, told
    apart by the context; the others are in classes by their last two bytes,
    within which (c + 1) counts, an unknown word being one more word of each.
    Words are told apart by 64-bit hashes. Null texts count as empty. Counts
    and vocabulary come from all training texts, and every position of each
    is trained on, once. A repeated doc_id gives a row for each of its rows.
    """
    folded = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("held_out"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.when(F.col("held_out"), -1).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS))).cast("int").alias("fold"),
    )
    counted = folded.where("not held_out").select("text").mapInArrow(_counting, "h long, n long, cls int")
    counts = staged(spark, counted.groupBy("h").agg(F.sum("n").alias("c"), F.max("cls").alias("cls")).where("c > 0"), "counts")
    v = vocabulary(counts)
    path = new_path(spark, "encoded")
    shipped = folded.mapInArrow(_encoding(v), _ENCODED).withColumn("uid", F.monotonically_increasing_id())
    shipped.write.option("compression", "zstd").partitionBy("fold").parquet(path)
    encoded = spark.read.schema(shipped.schema).parquet(path)
    model = Model(v)
    train(encoded, model)
    scored = encoded.select("uid", "doc_id", "held_out", "n_tokens", "known", "base", "rare", "symbols").mapInArrow(
        _scoring(model), "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, rare double, log_p double"
    )
    looked_up = encoded.select("uid", F.explode("missing").alias("h")).join(counts.select("h", "c"), "h", "left")
    others = looked_up.groupBy("uid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("gain"), F.count("c").alias("more"))
    gain, more = F.coalesce("gain", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return scored.join(others, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + more).cast("long").alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + gain - F.col("n_tokens") * F.lit(v.floor)).alias("base_score"),
        (F.col("log_p") + F.col("rare") + gain).alias("score"),
    )
