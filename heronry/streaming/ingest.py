"""Incremental ingestion: files that arrive in a folder are chunked, situated and stored batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heronry.plans.rag import Retrieval


def incoming(rag: Retrieval, folder: str, max_files: int = 1000) -> DataFrame:
    """(doc_id, markdown) of text files that arrive in folder; a batch has max_files at most."""
    files = rag.spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).load(folder)
    return files.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("doc_id"), F.col("value").alias("markdown"))


def ingest_stream(rag: Retrieval, docs: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Ingests a stream of documents. A batch that runs again replaces its documents, so nothing is doubled; the
    checkpoint takes the place of a list of what is done."""

    def ingest(batch: DataFrame, _: int) -> None:
        rag.ingest(batch)

    writer = docs.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
