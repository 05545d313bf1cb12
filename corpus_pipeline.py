"""From raw documents to token files: language ID, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All stages but
the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline.llm import decontaminate, lang_id, mixing, queries, simhash, token_output
from lodeline.llm.common import staged

#: A text whose language is less sure than this, or that has no letter, is rejected.
LEAST_SURE = 0.3


def _nested(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as the column ``row``, beside which no helper's name can clash with a column's."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the documents' languages; drop those without a letter or a likely language.

    Null and blank texts go, as do those without any letter. Texts of any
    length are judged whole, every row by itself, whatever its id: repeated
    rows and null ids stay or go by their text. An empty table, or one without
    a language to learn from, stays as it is. All columns come back as they
    were, also one named like a helper.
    """
    model = lang_id.train(docs.select("doc_id", "text", "lang"))
    if model is None:
        return docs
    found = lang_id.predict(spark, _nested(docs).select("row", "text"), model)
    return found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SURE)).select("row.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of texts that share 0.8 or more of their five-word shingles, as wide fingerprints tell it.

    The row with the smallest doc_id stays, one with a null id only if all of
    its class have none; ties of ids go by the texts' hashes, equal rows are
    one. Rows of one id with unlike texts are in classes of their own and all
    stay. Null and blank texts are one class. An empty table stays empty.
    """
    groups = simhash.near_groups(spark, docs)
    key = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")
    first = groups.groupBy("component").agg(F.min(key).alias("first")).select(F.xxhash64("first.doc_id", "first.text_hash").alias("number")).distinct()
    rows = _nested(docs).select("row", "doc_id", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("hash"))
    # Both steps go by the number, so that the texts are shuffled once; rows that share it are told apart in the second.
    kept = rows.withColumn("number", F.xxhash64("doc_id", "hash")).join(first, "number", "left_semi")
    turn = F.row_number().over(Window.partitionBy("number", "doc_id", "hash").orderBy(F.xxhash64("row")))
    return kept.withColumn("turn", turn).where("turn = 1").select("row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, also with other values in its slots.

    A row is judged by its text: rows with a null or a repeated id each by
    their own. Null and blank texts stay. Rows are told apart by a hash of id
    and text, so equal rows stay or go together.
    """
    number = F.xxhash64(F.col("doc_id"), F.col("text"))
    rows = _nested(docs).withColumn("number", number)
    found = decontaminate.leaks(rows.select(F.col("number").alias("doc_id"), "text"), queries.table(spark, sf_dir, "benchmark"))
    leaked = found.select(F.col("doc_id").alias("number")).distinct()
    return rows.join(leaked, "number", "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave whole documents so that sources come to their target sizes.

    Each row has its own turn in the order of its hash; rows with equal id,
    source and text are taken equally often, with a null id like others. Texts
    without words have no size and are never taken. A null source is a source.
    """
    number = F.xxhash64(F.col("doc_id"), F.col("text"), F.col("row.source").cast("string"))
    rows = _nested(docs).withColumn("number", number)
    sized = rows.select(F.col("number").alias("doc_id"), F.col("row.source").cast("string").alias("source"), "text")
    mixed = mixing.mix(spark, sized, whole=True)
    copies = F.max(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0)).cast("int")
    taken = mixed.groupBy(F.col("doc_id").alias("number")).agg(copies.alias("copies")).where("copies > 0")
    return rows.join(taken, "number").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files and return what each document has there.

    Rows are in order of doc_id, null first, then of text; each row, repeated
    ones too, has its ids and an end. Null and blank texts have the end alone.
    An empty table gives no file and no rows. Columns other than doc_id and
    text are not written.
    """
    folder, index = token_output.write_tokens(spark, docs, queries.tokenizer_path())
    return token_output.read_tokens(folder, index)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
    ("token_files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(spark, stage(spark, docs, sf_dir), name)
    return docs


#: Language ID and token output can't be expressed in SQL.
ORACLE_SQL = None
