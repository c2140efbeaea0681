"""The row-wise chunk and label steps on a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators.chunking import window_chunks


def read_document_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def described(docs: DataFrame) -> DataFrame:
    """Word count and warning of each document; works alike on tables and streams."""
    return docs.withColumn("n_words", T.word_count(F.col("text"))).withColumn("warning", T.input_warning(F.col("text")))


def stream_chunks(docs: DataFrame, checkpoint: str, out: str):
    """Write the word windows of a stream as Parquet, exactly once, until the source is drained."""
    chunks = window_chunks(docs, "doc_id")
    return chunks.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()


def events_per_window(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event type and window; late rows are taken until the watermark passes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
