"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local master, where one machine holds everything, may go without."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="lodeline-")
    return _own_dir


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that goes when the driver ends."""
    path = f"{shared_dir(spark)}/lodeline-{uuid.uuid4().hex}-{tag}"
    _made.append((spark, path))
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _made:
        try:
            remove_path(spark, path)
        except Exception:  # the session may be gone; the folder's owner cleans up then
            return


def staged(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage."""
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
