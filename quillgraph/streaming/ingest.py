"""Streams: documents into a store by micro-batch, and windowed activity with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.sources.store import Store


def activity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(event_type, start, n) by window; of a stream, windows close ``late`` after their end."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if at.isStreaming:
        at = at.withWatermark("ts", late)
    return at.groupBy("event_type", F.window("ts", window).alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def documents_into(spark: SparkSession, folder: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Ingests every Markdown file that appears in ``folder`` once. Identifiers come from content and the write is a merge, so a batch that is run again after a failure adds nothing twice."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(folder).select(F.col("value").alias("content"), F.col("_metadata.file_name").alias("name"))
    return files.writeStream.foreachBatch(lambda batch, _: store.add_markdown(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
