"""Connected components of a graph, by stars, without a driver-side graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm.common import staged


def contract(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of linked members; a class is named by its smallest member."""
    while True:
        la, lb = labels[a], labels[b]
        open_ = la != lb
        if not open_.any():
            return labels
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        parent = np.arange(len(labels))
        np.minimum.at(parent, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            further = parent[parent]
            if np.array_equal(further, parent):
                break
            parent = further
        labels = parent[labels]


#: Links of a node from which its minimum is broadcast rather than joined, and the most nodes that may be.
HOT = 512
BROADCAST_ROWS = 100_000


def _to_least(spark: SparkSession, rows: DataFrame, least: DataFrame, crowded: bool) -> DataFrame:
    """``rows`` (u, v) with m of ``least`` (u, m, n), without gathering the n links of a node in one task."""
    if not crowded:
        return rows.join(least.select("u", "m"), "u")
    least = staged(spark, least, "least")
    hot = least.where(F.col("n") > HOT).select("u", "m")
    known = hot.limit(BROADCAST_ROWS + 1).count()
    if not 0 < known <= BROADCAST_ROWS:
        return rows.join(least.select("u", "m"), "u")
    rest = rows.join(F.broadcast(hot.select("u")), "u", "left_anti").join(least.select("u", "m"), "u")
    return rows.join(F.broadcast(hot), "u").unionByName(rest)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an edge, where root is the smallest node it reaches.

    ``edges`` has the long columns a and b. Each round replaces every node's
    links by links to the smallest neighbour, first for larger and then for
    smaller neighbours; this keeps the components and ends in stars. Minima
    are aggregated before they are shuffled, and those of nodes with more than
    HOT links are broadcast, if there are no more than BROADCAST_ROWS of them;
    each round is a table in the shared folder.
    """
    now = staged(
        spark,
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    mark = _mark(now)
    while mark[0]:
        crowded = mark[0] > HOT
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _to_least(spark, both.where("v > u"), least, crowded).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        if crowded:
            large = staged(spark, large, "large")
        small_least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = (
            _to_least(spark, large, small_least, crowded)
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        now = staged(spark, small, "stars")
        was, mark = mark, _mark(now)
        if was == mark:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return int(row[0]), row[1]
