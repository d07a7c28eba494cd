"""Continuous ingest: new text files become batches of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.index import Index


def ingest_files(spark: SparkSession, folder: str, index: Index, checkpoint: str, glob: str = "*.md", available_now: bool = True) -> StreamingQuery:
    """Adds each new file of ``folder`` to ``index``, once.

    Spark's checkpoint remembers the files taken. Each batch of the stream is added under
    a token made of the checkpoint's path and its number, so one that is run again after
    a crash, with the same files, is not added twice."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", glob).load(folder)
    docs = files.select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))

    def add(batch: DataFrame, number: int) -> None:
        index.add(batch, token=f"{checkpoint.rstrip('/')}#{number}")

    writer = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
