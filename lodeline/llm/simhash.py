"""SimHash fingerprints and exact tiled linking of near-equal ones."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm.common import LOWER, hash_spans, mix64, sorted_groups, spans, staged, utf8, words_of
from lodeline.llm.components import components, contract

#: Bits that two linked fingerprints may differ in.
RADIUS = 2
#: Equal bit ranges of a fingerprint whose population counts name its tile.
RANGES = 4
#: Rows of a side of one comparison, and of a tile before it is dealt to several tasks.
BLOCK = 2048
TILE_ROWS = 16384
#: Rows of a block that are compared before the rest, and crowded tiles up to which their list is broadcast.
PIVOTS = 4
CROWDED_ROWS = 100_000
#: Lanes of 64 bits of a wide fingerprint at least: 768 bits tell a similarity of 0.8 from 0.75 by 1.6 standard deviations.
LANES = 12


def fingerprint(text: bytes, words: int = 3) -> int:
    """The 64-bit fingerprint of one text, unsigned; 0 without any word."""
    import xxhash

    split = text.lower().split()
    if not split:
        return 0
    if len(split) < words:
        shingles = [b" ".join(split)]
    else:
        shingles = map(b" ".join, zip(*(split[i:] for i in range(words))))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), shingles), np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        prints = np.fromiter((fingerprint(x.as_py() or b"") for x in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the unsigned bits in a long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _fingerprints, "doc_id long, fp long"
    )


def _steps() -> list[int]:
    """Differences of tile numbers within the radius, one of each opposite pair, and 0."""
    found = []
    for x in product(range(-RADIUS, RADIUS + 1), repeat=RANGES):
        first = next((y for y in x if y), 0)
        if sum(map(abs, x)) <= RADIUS and first >= 0:
            found.append(sum(y * 64**i for i, y in enumerate(x)))
    return sorted(found)


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of ``x`` and ``y`` whose fingerprints, in one or more lanes of 64 bits, lie within the radius."""
    far = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
    if x.shape[1] > 1:
        far = far.astype(np.uint16)
        for k in range(1, x.shape[1]):
            far += np.bitwise_count(x[:, None, k] ^ y[None, :, k])
    return np.nonzero(far <= radius)


def _link(labels: np.ndarray, prints: np.ndarray, ones: np.ndarray, own: int, inner: bool, radius: int) -> np.ndarray:
    """Classes of the first ``own`` rows, compared with the rows behind them and, if ``inner``, with each other."""
    for i in range(0, own, BLOCK):
        x = prints[i : min(i + BLOCK, own)]
        low, high = ones[i : i + len(x)].min() - radius, ones[i : i + len(x)].max() + radius
        for j in range(i if inner else own, len(prints), BLOCK):
            y = prints[j : j + BLOCK]
            if ones[j : j + len(y)].max() < low or ones[j : j + len(y)].min() > high:
                continue
            # In a crowd a few rows unite both blocks, and the rest of their pairs can add nothing.
            some = slice(0, len(x), max(1, len(x) // PIVOTS))
            a, b = _near(x[some], y, radius)
            labels = contract(labels, a * max(1, len(x) // PIVOTS) + i, b + j)
            if (labels[i : i + len(x)] == labels[i]).all() and (labels[j : j + len(y)] == labels[i]).all():
                continue
            a, b = _near(x, y, radius)
            labels = contract(labels, a + i, b + j)
    return labels


def _links(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links between the residents of each tile, and from them to its visitors: enough to connect what is linked."""
        for group in sorted_groups(batches, ["tile", "part"]):
            resident = group.column("resident").to_numpy()
            if not resident.any():
                continue
            fp = group.column("fp").combine_chunks()
            wide = fp.values.to_numpy() if pa.types.is_list(fp.type) else fp.to_numpy()
            prints = wide.view(np.uint64).reshape(group.num_rows, -1)
            ones = np.bitwise_count(prints).sum(axis=1, dtype=np.int64)
            order = np.lexsort((ones, ~resident))
            prints, ones, nodes = prints[order], ones[order], group.column("node").to_numpy()[order]
            own, n = int(resident.sum()), len(prints)
            inner = own == n or group.column("part")[0].as_py() < 0
            labels = _link(np.arange(n), prints, ones, own, inner, radius)
            far = np.flatnonzero(labels != np.arange(n))
            if len(far):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[labels[far]])], ["a", "b"])

    return link


def _dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` (node, fp, tile, resident) with the part of the tile that they go to; ``sizes`` has tile, residents and visitors.

    A tile with more than TILE_ROWS of either is dealt in blocks: each block
    of residents meets itself, each other block of them once, and each block
    of visitors, in parts of their own. Part -1 is a tile that isn't dealt.
    """
    blocks = lambda c: F.ceil(F.col(c) / F.lit(TILE_ROWS)).cast("int")
    crowded = sizes.select("tile", blocks("residents").alias("r"), blocks("visitors").alias("v")).where("r > 1 or (r = 1 and v > 1)")
    crowded = staged(rows.sparkSession, crowded, "crowded-tiles")
    found = crowded.limit(CROWDED_ROWS + 1).count()
    if not found:
        return rows.withColumn("part", F.lit(-1).cast("long"))
    placed = rows.join(F.broadcast(crowded) if found <= CROWDED_ROWS else crowded, "tile", "left")
    mine = F.pmod(F.xxhash64("fp", F.lit(5)), F.when(F.col("resident"), F.col("r")).otherwise(F.col("v"))).cast("int")
    width = (F.col("r") + F.col("v")).cast("long")
    part = lambda i, j, own: F.struct((i * width + j).alias("part"), F.lit(own).alias("resident"))
    r, v, b = F.col("r"), F.col("v"), F.col("mine")
    none = F.array().cast("array<int>")
    beside = F.concat(F.sequence(F.lit(0), b), F.when(v > 0, F.sequence(r, r + v - 1)).otherwise(none))
    above = F.when(b + 1 < r, F.sequence(b + 1, r - 1)).otherwise(none)
    as_resident = F.concat(F.transform(beside, lambda j: part(b, j, True)), F.transform(above, lambda i: part(i, b, False)))
    as_visitor = F.transform(F.sequence(F.lit(0), r - 1), lambda i: part(i, r + b, False))
    alone = F.array(F.struct(F.lit(-1).cast("long").alias("part"), F.col("resident").alias("resident")))
    goes = F.when(r.isNull(), alone).when(F.col("resident"), as_resident).otherwise(as_visitor)
    return placed.withColumn("mine", mine).select("node", "fp", "tile", F.explode(goes).alias("to")).select("node", "fp", "tile", "to.part", "to.resident")


def _linked(rows: DataFrame, sizes: DataFrame, radius: int) -> DataFrame:
    dealt = _dealt(rows, sizes).repartition("tile", "part").sortWithinPartitions("tile", "part")
    return dealt.mapInArrow(_links(radius), "a long, b long")


def fingerprint_links(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all of ``nodes`` (node, fp), distinct in fp, within the radius.

    A tile holds the fingerprints with the same population counts in each of
    four bit ranges. Two fingerprints within the radius lie in tiles whose
    counts differ by no more than it in total; other pairs of tiles are never
    formed. A row visits the tiles on one side of its own. Within a tile,
    blocks whose population counts differ beyond the radius are skipped.
    """
    size = 64 // RANGES
    mask = (1 << size) - 1
    tile = sum(
        ((F.bit_count(F.shiftrightunsigned("fp", i * size).bitwiseAND(F.lit(mask))) + F.lit(RADIUS)).cast("int") * F.lit(64**i) for i in range(RANGES)),
        start=F.lit(0),
    )
    own = nodes.select("node", "fp", tile.alias("tile"))
    steps = F.explode(F.array(*map(F.lit, _steps()))).alias("step")
    at = (F.col("tile") + F.col("step")).alias("tile")
    counts = own.groupBy("tile").agg(F.count("*").alias("rows"))
    sizes = counts.select("tile", "rows", steps).groupBy(at).agg(
        F.sum(F.when(F.col("step") == 0, F.col("rows")).otherwise(0)).alias("residents"), F.sum(F.when(F.col("step") != 0, F.col("rows")).otherwise(0)).alias("visitors")
    )
    rows = own.select("node", "fp", "tile", steps).select("node", "fp", at, (F.col("step") == 0).alias("resident"))
    return _linked(rows, sizes, RADIUS)


def simhash_groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text).

    Null and blank texts have the fingerprint 0 and are linked like others. A
    repeated doc_id gives a row for each of its rows, with that text's class.
    A row with a null doc_id is linked like others, but names a class only if
    all of it have none. Texts of any length count whole. Other columns are
    not read. An empty table gives no rows.
    """
    prints = staged(spark, fingerprints(docs), "fingerprints")
    numbered = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id())
    nodes = staged(spark, numbered, "nodes")
    roots = components(spark, fingerprint_links(spark, nodes))
    placed = nodes.join(roots, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _agreement(similarity: float) -> float:
    """The share of bits that two texts' fingerprints have in common, whose shingle sets have a Jaccard ``similarity``."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan(rows: int, similarity: float, missed: float) -> tuple[int, int, int, int]:
    """(lanes, bands, bits, radius) of wide fingerprints for so many rows.

    A band of ``bits`` bits holds about 256 unrelated rows a tile; so many
    bands that all of them differ, for a pair at the similarity, with no more
    than the probability ``missed``. The radius is the expected distance at
    the similarity and half a standard deviation.
    """
    agree = _agreement(similarity)
    bits = max(6, math.ceil(math.log2(max(rows, 1) / 256)))
    bands = math.ceil(math.log(missed) / math.log(1 - agree**bits))
    lanes = max(LANES, -(-bands * bits // 64))
    size = 64 * lanes
    return lanes, bands, bits, math.floor(size * (1 - agree) + 0.5 * math.sqrt(size * agree * (1 - agree)))


def _wide(lanes: int, words: int):
    """Fingerprints of several lanes; each lane has bits of its own from each shingle's hash."""
    seeds = mix64(np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def bits_of(hashes: np.ndarray) -> np.ndarray:
        counts = np.zeros(64 * lanes, np.int64)
        for i in range(0, len(hashes), 1 << 12):
            part = mix64(hashes[i : i + (1 << 12), None] ^ seeds[None, :])
            counts += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column("text"))
            out = np.zeros((batch.num_rows, lanes), np.uint64)
            for i, j in spans(offsets, 4 << 20):
                low, at = LOWER[buf[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
                starts, ends, counts = words_of(low, at)
                shingles = hash_spans(low, starts, ends)
                single = shingles
                for k in range(1, words):
                    shingles = mix64(shingles[: max(0, len(single) - k)] ^ (single[k:] * np.uint64(2) + np.uint64(k)))
                first = np.cumsum(counts) - counts
                for d in range(i, j):
                    a, n = int(first[d - i]), int(counts[d - i])
                    if n >= words:
                        out[d] = bits_of(shingles[a : a + n - words + 1])
                    elif n:
                        whole = single[a : a + 1]
                        for w in single[a + 1 : a + n]:
                            whole = mix64(whole * np.uint64(3) ^ w)
                        out[d] = bits_of(whole)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, lanes, dtype=np.int32)), pa.array(out.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), flat], ["doc_id", "text_hash", "fp"])

    return made


def _bands(bands: int, bits: int):
    """Each fingerprint once for every band, with the band's bits as the tile."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            prints = batch.column("fp").flatten().to_numpy().view(np.uint8).reshape(batch.num_rows, -1)
            own = np.unpackbits(prints, axis=1, bitorder="little")[:, : bands * bits].reshape(-1, bands, bits)
            keys = own.astype(np.int64) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
            for k in range(bands):
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("fp"), pa.array(keys[:, k] * bands + k)], ["node", "fp", "tile"])

    return cut


def near_groups(spark: SparkSession, docs: DataFrame, words: int = 5, similarity: float = 0.8, missed: float = 0.02) -> DataFrame:
    """(doc_id, text_hash, component) of every row of ``docs`` (doc_id, text): classes of texts that share most shingles.

    Fingerprints of 64 bits can't tell a similarity of 0.8, so these are
    wider, see ``plan``. Rows that agree in all bits of a band share a tile;
    within tiles all fingerprints are compared, and those within the radius
    are linked. ``text_hash`` is the XXH64 of the text, null for none, so that
    rows without an id, or with a repeated one, can be told apart. Texts of
    fewer words are one shingle; null and blank texts have the fingerprint 0
    and are one class. Other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lanes, bands, bits, radius = plan(texts.count(), similarity, missed)
    keyed = texts.withColumn("text_hash", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    prints = staged(spark, keyed.mapInArrow(_wide(lanes, words), "doc_id long, text_hash long, fp array<long>"), "wide-prints")
    nodes = staged(spark, prints.select("fp").distinct().withColumn("node", F.monotonically_increasing_id()), "wide-nodes")
    rows = nodes.select("node", "fp").mapInArrow(_bands(bands, bits), "node long, fp array<long>, tile long").withColumn("resident", F.lit(True))
    sizes = nodes.select("node", "fp").mapInArrow(_bands(bands, bits), "node long, fp array<long>, tile long").groupBy("tile").agg(
        F.count("*").alias("residents"), F.lit(0).alias("visitors")
    )
    roots = components(spark, _linked(rows, sizes, radius))
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component"))
    return prints.join(named, "fp").select("doc_id", "text_hash", "component")
