"""Token ids of equal-length sequences in Arrow stream files, and reading them back."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline.llm.common import hash_spans, new_path, same_spans, sorted_groups, spans, staged, utf8

#: Ids of a sequence, and sequences of a record batch.
LENGTH = 2048
BATCH_ROWS = 128
#: Bytes of text encoded at once, and ids of pieces remembered by a Python worker. Both set its memory, not what is written.
CHUNK = 1 << 20
REMEMBERED = 4_000_000

_encoders: dict[str, "PieceEncoder"] = {}


def encoder(path: str) -> "PieceEncoder":
    """The encoder of this Python worker for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


class PieceEncoder:
    """Encodes texts with a byte-level BPE tokenizer, each distinct piece once.

    Byte-level BPE never joins what lies before and behind a space that a
    visible character follows. Texts are cut there, and the tokenizer encodes
    each piece that is new to this worker; known pieces are looked up by a
    64-bit hash and compared byte by byte. Should two pieces share a hash, the
    texts at hand are encoded without the memory, which is only a matter of
    speed and starts anew when it is full. All of it is done in blocks of
    about ``CHUNK`` bytes that end where a text is cut, so that a long text
    needs no more room than short ones; only a piece isn't divided.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        tokens = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.opens = np.array([t is not None and t.startswith("Ġ") for t in tokens])
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.firsts = np.zeros(0, self.kind), np.zeros(1, np.int64)
        self.bytes, self.begins = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, one after the other, and how many each text has."""
        found, counts = [np.zeros(0, self.kind)], np.zeros(len(offsets) - 1, np.int64)
        for at, stop in _blocks(buf):
            ids, longs = self._block(buf[at:stop], np.clip(offsets, at, stop) - at)
            found.append(ids)
            counts += longs
        return np.concatenate(found), counts

    def _block(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ``encode`` returns, for a block."""
        n = len(buf)
        after = np.zeros(n, np.uint8)
        after[:-1] = buf[1:]
        cut = np.zeros(n + 1, bool)
        cut[:-1] = (buf == 32) & _VISIBLE[after]
        cut[offsets] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], n)
        keys = hash_spans(buf, starts, ends)
        import pandas as pd

        codes, distinct = pd.factorize(keys)
        where = np.empty(len(distinct), np.int64)
        where[codes[::-1]] = np.arange(len(codes))[::-1]
        if not same_spans(buf, starts, ends, buf, starts[where][codes], ends[where][codes]).all():
            return self._plainly(buf, starts, ends, offsets)
        if len(self.ids) > REMEMBERED:
            self._forget()
        slot, known = self._find(distinct)
        old, of = np.flatnonzero(known), slot[known]
        if len(old) and not same_spans(buf, starts[where[old]], ends[where[old]], self.bytes, self.begins[of], self.begins[of + 1]).all():
            return self._plainly(buf, starts, ends, offsets)
        if not known.all():
            new = np.flatnonzero(~known)
            self._learn(buf, distinct[new], starts[where[new]], ends[where[new]])
            slot, known = self._find(distinct)
        first, long = self.firsts[slot][codes], (self.firsts[slot + 1] - self.firsts[slot])[codes]
        total = np.concatenate(([0], np.cumsum(long)))
        out = self.ids[np.repeat(first - total[:-1], long) + np.arange(total[-1])]
        return out, np.diff(total[np.searchsorted(starts, offsets)])

    def _plainly(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ``_block`` returns, without the memory of pieces."""
        data = buf.tobytes()
        found = self._ids([data[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())])
        total = np.concatenate(([0], np.cumsum([len(x) for x in found])))
        return np.array([i for x in found for i in x], self.kind), np.diff(total[np.searchsorted(starts, offsets)])

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        order = np.argsort(keys)
        at = np.empty(len(keys), np.int64)
        at[order] = np.searchsorted(self.keys, keys[order])
        at = np.minimum(at, len(self.keys) - 1)
        return self.at[at], self.keys[at] == keys

    def _learn(self, buf: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        data = buf.tobytes()
        spaces = np.concatenate(([0], np.cumsum(buf == 32)))
        simple = (spaces[ends] - spaces[starts] == 1) & (buf[starts] == 32)
        parts: list[np.ndarray] = []
        if simple.any():
            text = b"".join(data[a:b] for a, b in zip(starts[simple].tolist(), ends[simple].tolist())).decode("utf-8", "replace")
            ids = np.array(self._ids([text])[0], self.kind)
            opens = np.flatnonzero(self.opens[ids])
            if len(opens) == int(simple.sum()):
                longs = np.diff(np.append(opens, len(ids)))
                parts.append(ids)
            else:  # a vocabulary whose tokens do not show where pieces begin
                simple = np.zeros(len(starts), bool)
        if not simple.any():
            longs = np.zeros(0, np.int64)
        rest = [data[a:b].decode("utf-8", "replace") for a, b in zip(starts[~simple].tolist(), ends[~simple].tolist())]
        others = [np.array(x, self.kind) for x in self._ids(rest)]
        pieces = [data[a:b] for a, b in zip(starts[simple].tolist(), ends[simple].tolist())]
        pieces += [data[a:b] for a, b in zip(starts[~simple].tolist(), ends[~simple].tolist())]
        self.bytes = np.concatenate((self.bytes, np.frombuffer(b"".join(pieces), np.uint8)))
        self.begins = np.concatenate((self.begins, self.begins[-1] + np.cumsum([len(x) for x in pieces])))
        keys = np.concatenate((keys[simple], keys[~simple]))
        longs = np.concatenate((longs, np.array([len(x) for x in others], np.int64)))
        slots = len(self.firsts) - 1
        self.firsts = np.concatenate((self.firsts, self.firsts[-1] + np.cumsum(longs)))
        self.ids = np.concatenate((self.ids, *parts, *others))
        order = np.argsort(keys)
        place = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, place, keys[order])
        self.at = np.insert(self.at, place, slots + order)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        if not texts:
            return []
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


#: Bytes that begin a character that surely isn't white space or control.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0xC3:0xF5] = True
_VISIBLE[[0xE1, 0xE2, 0xE3]] = False


def _blocks(buf: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``CHUNK`` bytes that end before a space with a visible character behind it, or with the bytes."""
    at, n = 0, len(buf)
    while at < n:
        low, stop = at + 1, at + CHUNK
        while stop < n:
            places = np.flatnonzero((buf[low:stop] == 32) & _VISIBLE[buf[low + 1 : stop + 1]])
            if len(places):
                stop = low + int(places[-1])
                break
            low, stop = stop, stop + CHUNK
        yield at, min(stop, n)
        at = stop


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pyarrow.fs.FileSystem.from_uri(path)


def file_schema(kind: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Packs ids into sequences of one length, and those into record batches of one size."""

    def __init__(self, path: str, kind: np.dtype, length: int, rows: int):
        self.files, self.path = file_system(path)
        self.schema, self.kind, self.length, self.size = file_schema(kind, length), kind, length, length * rows
        self.draft = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.sink = self.files.open_output_stream(self.draft)
        self.stream = pa.ipc.new_stream(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.count = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.total += len(ids)
        while len(ids):
            take = ids[: self.size - self.count]
            self.held.append(take)
            self.count += len(take)
            ids = ids[len(take) :]
            if self.count == self.size:
                self._flush()

    def _flush(self) -> None:
        ids = np.concatenate(self.held)
        self.held, self.count = [], 0
        full = -(-len(ids) // self.length) * self.length
        mask = np.zeros(full, bool)
        mask[: len(ids)] = True
        padded = np.zeros(full, self.kind)
        padded[: len(ids)] = ids
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, mask)]
        self.stream.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.count:
            self._flush()
        self.stream.close()
        self.sink.close()
        self.files.move(self.draft, self.path)


def read_sequences(path: str) -> Iterator[np.ndarray]:
    """The ids of a file, a record batch at a time, without its padding."""
    files, name = file_system(path)
    with files.open_input_file(name) as source, pa.ipc.open_stream(source) as stream:
        for batch in stream:
            ids, mask = batch.column("ids"), batch.column("mask")
            yield ids.flatten().to_numpy(zero_copy_only=True)[: int(pa.compute.sum(mask.flatten().cast(pa.int64())).as_py() or 0)]


class SequenceFile:
    """Random access to the sequences of a local file through a memory map."""

    def __init__(self, path: str):
        self.source = pa.memory_map(path)
        self.batches = list(pa.ipc.open_stream(self.source))
        self.ends = np.cumsum([b.num_rows for b in self.batches])

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def __getitem__(self, row: int) -> tuple[np.ndarray, pa.Array]:
        """The ids, without a copy, and the mask of a sequence."""
        if not 0 <= row < len(self):
            raise IndexError(row)
        k = int(np.searchsorted(self.ends, row, "right"))
        batch = self.batches[k]
        i = row - (int(self.ends[k]) - batch.num_rows)
        return batch.column("ids")[i].values.to_numpy(zero_copy_only=True), batch.column("mask")[i].values


def _writing(folder: str, tokenizer: str, end_id: int, length: int, rows: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, out = encoder(tokenizer), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = SequenceWriter(f"{folder}/part-{part:06d}.arrows", encode.kind, length, rows)
            buf, offsets = utf8(batch.column("text"))
            firsts, longs = [], []
            for i, j in spans(offsets, CHUNK):
                ids, counts = encode.encode(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ends = np.cumsum(counts)
                with_ends = np.insert(ids, ends, np.array(end_id, encode.kind))
                firsts.append(out.total + ends - counts + np.arange(len(counts)))
                longs.append(counts + 1)
                out.add(with_ends)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(batch.num_rows, part)), pa.array(np.concatenate(firsts)), pa.array(np.concatenate(longs))],
                ["doc_id", "part", "first", "n_tokens"],
            )
        if out is not None:
            out.close()

    return write


def write_tokens(
    spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = LENGTH, rows: int = BATCH_ROWS
) -> tuple[str, DataFrame]:
    """Write all texts' ids in order of doc_id; returns the folder and the index.

    Each range of ids of documents is one Arrow stream file of batches with
    the fixed-size lists ``ids`` and ``mask``; only a file's last sequence is
    padded, with mask false. The index (doc_id, part, first, n_tokens) holds
    each document's place among the ids of its file. Null texts count as
    empty, equal ids are in order of their texts, null ids come first.
    """
    folder = new_path(spark, "tokens")
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folder = hadoop.makeQualified(jvm_path).toString()
    hadoop.mkdirs(jvm_path)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    written = ordered.mapInArrow(_writing(folder, tokenizer, end_id, length, rows), "doc_id long, part long, first long, n_tokens long")
    return folder, staged(spark, written, "token-index")


def _reading(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["part"]):
            longs = group.column("n_tokens").to_numpy()
            ends = np.cumsum(longs)
            sums, at, now, k = np.zeros(len(longs), np.int64), 0, 0, 0
            for ids in read_sequences(f"{folder}/part-{group.column('part')[0].as_py():06d}.arrows"):
                words, done = ids.astype("<u4"), 0
                while k < len(ends) and done < len(words):
                    stop = min(len(words), int(ends[k]) - at)
                    now = zlib.crc32(words[done:stop].tobytes(), now)
                    done = stop
                    if at + stop == ends[k]:
                        sums[k], now, k = now, 0, k + 1
                at += len(words)
            if k != len(ends) or at != (ends[-1] if len(ends) else 0):
                raise ValueError(f"part {group.column('part')[0]} holds {at} ids; its index says {ends[-1]}")
            yield pa.RecordBatch.from_arrays(
                [*(group.column(c).combine_chunks() for c in ("doc_id", "part", "first", "n_tokens")), pa.array(sums)],
                ["doc_id", "part", "first", "n_tokens", "ids_crc32"],
            )

    return read


def read_tokens(folder: str, index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files.

    ``start`` counts the ids of all documents before it, over all files.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    parts = parts.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0).cast("long")).alias("part_start"))
    dealt = index.repartition("part").sortWithinPartitions("part", "first")
    read = dealt.mapInArrow(_reading(folder), "doc_id long, part long, first long, n_tokens long, ids_crc32 long")
    return read.join(parts, "part").select("doc_id", (F.col("part_start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
