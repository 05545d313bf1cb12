"""Byte-level word splitting and hashing, and groups of sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeline.sources.staging import new_path, staged

__all__ = ["new_path", "staged"]

#: White space that ends a word: space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of a key's text, modulo a number: the fold of a row."""
    return F.pmod(F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")), F.lit(modulus))


def utf8(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins (one more at the end)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def spans(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes, each of one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many each text has. No word spans two texts."""
    n = len(buf)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets) - 1, np.int64)
    ink = ~_SPACE[buf]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = ink[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = ink[1:]
    starts = np.flatnonzero(ink & (~before | fresh[:-1]))
    ends = np.flatnonzero(ink & (~after | fresh[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


#: Bytes of a stretch above which it is hashed and compared on its own instead of eight bytes at a time with all others.
LONG = 512
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits of an unsigned 64-bit value."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    return np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes: eight bytes at a time are mixed in, long ones by XXH64.

    Every step mixes all bits, so that no family of texts collides by its form.
    """
    import xxhash

    longs = ends - starts
    h = mix64(longs.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if not len(starts):
        return h
    eights = _eights(buf)
    left, at, open_ = longs.copy(), starts.copy(), np.flatnonzero((longs > 0) & (longs <= LONG))
    while len(open_):
        now = left[open_]
        part = eights[at[open_]] & _TAIL[np.minimum(now, 8)]
        h[open_] = mix64(h[open_] ^ part) + np.uint64(0xD6E8FEB86659FD93)
        at[open_] += 8
        left[open_] = now - 8
        open_ = open_[now > 8]
    for i in np.flatnonzero(longs > LONG):
        h[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]].tobytes(), seed=7)
    return h


def same_spans(a: np.ndarray, starts: np.ndarray, ends: np.ndarray, b: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """Whether each stretch of ``a`` holds the same bytes as its stretch of ``b``."""
    longs = ends - starts
    same = longs == lasts - firsts
    x, y = _eights(a), _eights(b)
    done, open_ = 0, np.flatnonzero(same & (longs > 0) & (longs <= LONG))
    while len(open_):
        now = longs[open_] - done
        tail = _TAIL[np.minimum(now, 8)]
        equal = (x[starts[open_] + done] & tail) == (y[firsts[open_] + done] & tail)
        same[open_[~equal]] = False
        open_, done = open_[equal & (now > 8)], done + 8
    for i in np.flatnonzero(same & (longs > LONG)):
        same[i] = np.array_equal(a[starts[i] : ends[i]], b[firsts[i] : lasts[i]])
    return same


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by the keys, one at a time, whatever the batches' bounds.

    Each batch is looked at once; a group's batches are joined when it ends.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for k in keys:
            c = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= c[1:] != c[:-1]
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        change[0] = last is not None and first != last
        last = tuple(batch.column(k)[n - 1].as_py() for k in keys)
        at = 0
        for cut in np.flatnonzero(change):
            if cut > at:
                held.append(batch.slice(at, cut - at))
            yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)
