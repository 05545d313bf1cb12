"""Mixing sources to target weights by hash order, prefix sums and exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline.llm.common import staged

#: Hex digits of a row's key that name its range within the source: 4096 ranges.
RANGE_DIGITS = 3


def word_count(text: Column | str) -> Column:
    """Number of words: stretches without white space. Null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) for ``sizes`` (source, source_size).

    Sources by code point, null last, have the weights in turn and share
    ``share`` of all sizes. A target stops at ``most`` times its source's size;
    the excess goes to the others by weight until none is above. Sorted by
    size for each unit of weight, the stopped sources come first, so the level
    of the others follows from running sums over the sources.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(in_order) - 1) % F.lit(len(weights))
    weighed = sizes.withColumn("turn", turn).select(
        "source",
        "source_size",
        F.element_at(F.array(*map(F.lit, weights)), F.col("turn") + 1).cast("double").alias("weight"),
        (F.col("source_size") * F.lit(float(most))).alias("stop"),
    )
    everything = Window.partitionBy()
    rising = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    ahead = rising.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("stop").over(ahead), F.lit(0.0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0)))
    with_level = weighed.withColumn("level", level).withColumn("stops", F.col("stop") <= F.col("level") * F.col("weight"))
    free = F.max(F.when(~F.col("stops"), F.col("level"))).over(everything)
    return with_level.withColumn("free", free).select(
        "source",
        "source_size",
        F.when(F.col("stops") | F.col("free").isNull(), F.col("stop")).otherwise(F.col("free") * F.col("weight")).alias("target"),
    )


def mix(
    spark: SparkSession,
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    whole: bool = False,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs``.

    A row's key is a hash of its id, the rows of a source are taken in the
    order of keys until the source's budget, the target without its fraction,
    is used up, and the order starts anew while the budget exceeds the source.
    ``taken`` counts words. With ``whole`` the document at the cut is taken
    whole if half of it fits, else left; otherwise only its words up to the
    budget count. Keys are spread over ranges, so that the prefix sums of one
    source are computed by many tasks: within the ranges, and over the
    ranges' totals.

    Null or blank texts have size 0 and are never taken; a null source is a
    source. Rows with equal ids have equal keys and follow each other.
    """
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))).alias("key"),
    ).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    rows = staged(spark, keyed, "sizes")
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    sources = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    targets = source_targets(sources, weights, share, most)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("start", F.coalesce(F.sum("range_size").over(before), F.lit(0))).alias("s")
    starts = starts.join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        F.col("s.source").alias("source_"), F.col("s.range").alias("range_"), "start", "source_size", "target"
    )
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(starts, placed["source"].eqNullSafe(starts["source_"]) & (placed["range"] == starts["range_"]))
    budget = F.floor("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - rounds * F.col("source_size") - F.col("start") - F.col("inner")
    if whole:
        part = F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(0)
    else:
        part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", (rounds * F.col("size") + part).cast("long").alias("taken")
    )
