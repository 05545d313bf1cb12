"""Near-equal vectors: sorted projection passes, verified links, components and exact link counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline.llm.common import sorted_groups, staged
from lodeline.llm.components import components, contract

#: Neighbours that a vector is compared with in each pass, and rows of a task's stretch of the order.
NEIGHBOURS = 48
STRETCH = 4096
#: Bits of a pass's key, passes at first and at most, and the share of linked pairs that all passes together may miss.
BITS = 60
FIRST, MOST = 4, 96
MISSED = 1e-4
#: Rows of a block when a class of linked vectors is compared with itself; groups up to which their passes are broadcast.
BLOCK = 1024
FEW_GROUPS = 10_000


def passes_for(shared: int, cosine: float, missed: float = MISSED) -> int:
    """Passes so that a pair at the threshold is missed by all of them with no more than ``missed``.

    ``shared`` is the number of leading bits that a row's key has in common
    with the key at the far end of its window: a pair whose keys agree in one
    bit more lies within the window. One bit agrees with 1 - angle / pi.
    """
    agree = (1 - math.acos(cosine) / math.pi) ** (shared + 1)
    return min(MOST, max(FIRST, math.ceil(math.log(missed) / math.log(1 - agree))))


def _vectors(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The vectors as rows of unit length in double precision."""
    data = table.column("v")
    flat = (data.combine_chunks() if isinstance(data, pa.ChunkedArray) else data).to_numpy(zero_copy_only=False)
    x = np.frombuffer(b"".join(flat), "<f8").reshape(len(flat), -1)
    return x


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose vector can be compared, scaled to length 1, as bytes."""
    import pyarrow.compute as pc

    for batch in batches:
        data = batch.column("embedding")
        longs = pc.fill_null(pc.list_value_length(data), 0).to_numpy()
        flat = data.flatten().to_numpy(zero_copy_only=False)  # null components are NaN here
        starts = np.cumsum(longs) - longs
        for d in np.unique(longs[longs > 0]):
            rows = np.flatnonzero(longs == d)
            x = flat[starts[rows][:, None] + np.arange(d)[None, :]].astype(np.float64)
            top = np.abs(x).max(axis=1)
            usable = np.isfinite(top) & (top > 0)
            rows, x = rows[usable], x[usable] / top[usable][:, None]
            x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] + 0.0
            size = int(d) * 8
            # A column of binary values has 32-bit offsets.
            for i in range(0, len(rows), max(1, (1 << 30) // size)):
                part, take = x[i : i + max(1, (1 << 30) // size)], pa.array(rows[i : i + max(1, (1 << 30) // size)])
                ends = pa.py_buffer(np.arange(0, (len(part) + 1) * size, size, dtype=np.int32))
                units = pa.Array.from_buffers(pa.binary(), len(part), [None, ends, pa.py_buffer(np.ascontiguousarray(part, "<f8"))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(take), batch.column("label").take(take), pa.array(np.full(len(part), d, np.int32)), units],
                    ["vec_id", "label", "dim", "v"],
                )


def _keys(first: int, seed: int):
    """Each vector once for every pass from ``first`` to its own number of passes, with the signs of that pass's random projections as the key."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            dims, passes = batch.column("dim").to_numpy(), batch.column("passes").to_numpy()
            for d in np.unique(dims):
                for p in range(first, int(passes[dims == d].max(initial=0))):
                    part = batch.filter(pa.array((dims == d) & (passes > p)))
                    if (int(d), p) not in planes:
                        planes[int(d), p] = np.random.default_rng([seed, int(d), p]).normal(size=(int(d), BITS))
                    signs = _vectors(part) @ planes[int(d), p] > 0
                    keys = signs.astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(signs), p, np.int32)), part.column("label"), part.column("dim"), pa.array(keys), part.column("node"), part.column("v")],
                        ["pass", "label", "dim", "key", "node", "v"],
                    )

    return key


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        names = ["pass", "label", "dim", "key", "node", "v"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], [*names, "part", "at"])
        at += n


def _neighbours(cosine: float, width: int):
    """Links (a, b) of rows within the window of each other; and for each group of a stretch, without a link, how crowded its keys are.

    ``shared`` is the longest prefix that a row's key shares with the one at
    the far end of its window, where these two aren't linked themselves.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch in sorted_groups(batches, ["stretch"]):
            for group in sorted_groups(iter(stretch.to_batches()), ["pass", "label", "dim"]):
                n = group.num_rows
                if n < 2:
                    continue
                x, nodes = _vectors(group), group.column("node").to_numpy()
                labels, shared = np.arange(n), 0
                for d in range(1, min(width, n - 1) + 1):
                    linked = np.einsum("ij,ij->i", x[:-d], x[d:]) >= cosine
                    near = np.flatnonzero(linked)
                    if len(near):
                        labels = contract(labels, near, near + d)
                    if d == width and not linked.all():
                        keys = group.column("key").to_numpy()
                        differ = int((keys[:-d] ^ keys[d:])[~linked].min())
                        shared = BITS - differ.bit_length()
                far = np.flatnonzero(labels != np.arange(n))
                none = pa.nulls(len(far), pa.int32())
                yield _link_batch(nodes[far], nodes[labels[far]], pa.nulls(len(far), pa.string()), none, none)
                yield _link_batch([None], [None], group.column("label").combine_chunks()[:1], group.column("dim").combine_chunks()[:1], [shared])

    return link


def _link_batch(a, b, label, dim, shared) -> pa.RecordBatch:
    columns = (pa.array(a, pa.int64()), pa.array(b, pa.int64()), label, dim, pa.array(shared, pa.int32()))
    return pa.RecordBatch.from_arrays(list(columns), ["a", "b", "label", "dim", "shared"])


def _passes(spark: SparkSession, nodes: DataFrame, first: int, cosine: float, neighbours: int, seed: int) -> DataFrame:
    """Links and crowding from passes ``first`` to ``passes`` over ``nodes`` (label, dim, node, v, passes)."""
    keyed = nodes.select("label", "dim", "node", "v", "passes").mapInArrow(_keys(first, seed), "pass int, label string, dim int, key long, node long, v binary")
    ordered = keyed.repartitionByRange("pass", "label", "dim", "key", "node").sortWithinPartitions("pass", "label", "dim", "key", "node")
    placed = staged(spark, ordered.mapInArrow(_place, "pass int, label string, dim int, key long, node long, v binary, part int, at long"), "order")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    number = F.col("start") + F.col("at")
    stretch = F.floor(number / STRETCH)
    overlapping = F.when((number % STRETCH < neighbours) & (number >= STRETCH), F.array(stretch, stretch - 1)).otherwise(F.array(stretch))
    dealt = placed.join(starts, "part").select("pass", "label", "dim", "key", "node", "v", number.alias("number"), F.explode(overlapping).alias("stretch"))
    linked = dealt.repartition("stretch").sortWithinPartitions("stretch", "number").mapInArrow(
        _neighbours(cosine, neighbours), "a long, b long, label string, dim int, shared int"
    )
    return staged(spark, linked, "links")


def _counting(cosine: float):
    """For the rows of one block, how many vectors of all blocks of the class are linked to each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["root", "block", "other"]):
            own = group.column("own").to_numpy()
            x, n = _vectors(group), group.column("copies").to_numpy()
            a, b = x[own], x[~own]
            weights = n[~own]
            found = np.zeros(len(a), np.int64)
            for i in range(0, len(b), BLOCK):
                found += (a @ b[i : i + BLOCK].T >= cosine) @ weights[i : i + BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array(group.column("node").to_numpy()[own]), pa.array(found)], ["node", "links"])

    return count


def near_vectors(spark: SparkSession, rows: DataFrame, cosine: float = 0.98, neighbours: int = NEIGHBOURS, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id) of every row of ``rows`` (vec_id, embedding, label).

    Equal vectors of a label are one node with a number of copies. In each
    pass the nodes are sorted by label and the signs of random projections,
    each is compared with the next ``neighbours`` in that order, and pairs of
    at least ``cosine`` are united; a pass's order is cut into stretches that
    overlap, so that no label is one task's. The first four passes measure how
    crowded the keys of each label are; from that follows how many more it
    has, MOST at most, see passes_for. Within each component found, all
    vectors are then compared in blocks, which makes the counts of links exact
    there and finds what lay beyond a window.

    Rows whose vector is null, empty, zero or holds a null or non-finite
    component, or whose label is null, have no links and are their own
    component. Vectors of different lengths don't link. A repeated vec_id
    gives a row for each of its rows; equal rows link with each other.
    """
    ids = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    usable = ids.where("label is not null and vec_id is not null and embedding is not null")
    unit = usable.select("vec_id", "label", "embedding").mapInArrow(_unit, "vec_id long, label string, dim int, v binary")
    vectors = staged(spark, unit, "vectors")
    nodes = staged(spark, vectors.groupBy("label", "dim", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "nodes")
    found = _passes(spark, nodes.withColumn("passes", F.lit(FIRST)), 0, cosine, neighbours, seed)
    crowd = found.where("shared is not null").groupBy("label", "dim").agg(F.max("shared").alias("shared"))
    needed = F.element_at(F.array(*(F.lit(passes_for(k, cosine)) for k in range(BITS + 1))), F.col("shared") + 1)
    more = staged(spark, crowd.select("label", "dim", needed.alias("passes")).where(F.col("passes") > FIRST), "passes")
    groups = more.limit(FEW_GROUPS + 1).count()
    links = found.where("a is not null").select("a", "b")
    if groups:
        rest = nodes.join(F.broadcast(more) if groups <= FEW_GROUPS else more, ["label", "dim"])
        links = links.unionByName(_passes(spark, rest, FIRST, cosine, neighbours, seed).where("a is not null").select("a", "b"))
    roots = components(spark, links)
    grouped = nodes.join(roots, "node")
    sizes = grouped.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = grouped.join(sizes, "root").select("root", "node", "v", "copies", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("at"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    owners = members.select("root", F.col("at").alias("block"), F.explode(every).alias("other"), F.lit(True).alias("own"), "node", "copies", "v")
    others = members.select("root", F.explode(every).alias("block"), F.col("at").alias("other"), F.lit(False).alias("own"), "node", "copies", "v")
    pairs = owners.unionByName(others).repartition("root", "block", "other").sortWithinPartitions("root", "block", "other")
    counted = pairs.mapInArrow(_counting(cosine), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    found = nodes.join(roots, "node", "left").join(counted, "node", "left").select(
        F.col("label").alias("label_"),
        F.col("dim").alias("dim_"),
        F.col("v").alias("v_"),
        F.coalesce("links", "copies").alias("links"),
        F.coalesce("root", "node").alias("root"),
    )
    linked = vectors.join(found, (vectors["label"] == found["label_"]) & (vectors["dim"] == found["dim_"]) & (vectors["v"] == found["v_"]))
    linked = linked.select("vec_id", (F.col("links") - 1).alias("n_links"), F.col("root").alias("component_id"))
    alone = ids.where(
        F.col("label").isNull() | F.col("vec_id").isNull() | F.col("embedding").isNull() | (F.size("embedding") == 0)
        | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
        | F.forall("embedding", lambda x: x == 0)
    )
    return linked.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
