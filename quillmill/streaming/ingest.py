"""Incremental ingest: new files once, through the same stage functions as a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmill.sources.files import stem_of
from quillmill.sources.sinks import write_documents
from pyspark.sql import functions as F


def ingest_text(spark: SparkSession, source: str, out: str, checkpoint: str, stage: Callable[[DataFrame], DataFrame] = lambda df: df, trigger_once: bool = True):
    """Text files that weren't seen yet become documents; each micro-batch is a batch of its own, so a repeated one replaces itself."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(source)
    text = F.when(F.expr("is_valid_utf8(CAST(content AS STRING))"), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    docs = files.select(stem_of(F.col("path")).alias("document_id"), F.col("path").alias("source_path"), text.alias("text"))

    def write(batch: DataFrame, number: int) -> None:
        write_documents(stage(batch), out, batch_id=f"{number:09d}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger_once else writer).start()
