"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import staged

#: Classes up to which their counts are broadcast.
FEW_CLASSES = 10_000


def class_sample(rows: DataFrame, key: str, label: str, per_class: int, seed: int = 11) -> DataFrame:
    """About ``per_class`` rows of each label, all if there are fewer, picked by a hash of the key.

    Counts come from all rows; then a row stays if its hash lies below its
    class's share. Rows without a label go. The choice doesn't depend on how the rows are partitioned.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label_")).agg(F.count("*").alias("rows_"))
    counts = staged(rows.sparkSession, counts, "class-counts")
    few = counts.limit(FEW_CLASSES + 1).count() <= FEW_CLASSES
    part = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    both = rows.join(F.broadcast(counts) if few else counts, F.col(label) == F.col("label_"))
    return both.where(part < F.lit(float(per_class)) / F.col("rows_")).select(rows.columns)
