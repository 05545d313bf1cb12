"""Keeping a folder of postings up to date from a stream of documents. An addition: batch indexing is the rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodeline.operators.retrieval import as_corpus, build_index


def index_stream(documents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's postings under its own number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        build_index(as_corpus(batch)).postings.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
