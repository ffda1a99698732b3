"""Incremental indexing and event windows on Structured Streaming (beyond the reference, which rebuilds an index when its files change)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions.text import collapse
from lectern.operators.chunking import windows
from lectern.operators.vectors import HashingEmbedder, embed


def chunk_stream(pages: DataFrame, make=HashingEmbedder) -> DataFrame:
    """Pages (source_file, page, text) to embedded chunks, row by row, so it runs on streams and tables alike."""
    return embed(windows(pages.withColumn("clean", collapse(F.col("text"))).drop("text")), "chunk", make=make)


def append_to_store(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each file once, all that is there now; a run that is cut short goes on from its checkpoint."""
    return chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(spark: SparkSession, folder: str, path: str, checkpoint: str) -> StreamingQuery:
    pages = spark.readStream.schema("source_file string, page bigint, text string").parquet(folder)
    return append_to_store(chunk_stream(pages), path, checkpoint)


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; state older than the watermark goes."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return t.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
