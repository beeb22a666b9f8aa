"""Structured Streaming over newly landed reads: first-wins merging and windowed channel activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def landed(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the Parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def merged(reads: DataFrame, time: str, lateness: str = "1 hour", key: str = "read_id") -> DataFrame:
    """Each id once, the first that arrives within the lateness; state older than the watermark is dropped."""
    return reads.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def channel_activity(reads: DataFrame, time: str, window: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Reads and samples per channel and window."""
    return (
        reads.withWatermark(time, lateness)
        .groupBy(F.window(time, window), "channel")
        .agg(F.count("*").alias("reads"), F.sum("num_samples").alias("samples"))
        .select(F.col("window.start").alias("window_start"), "channel", "reads", "samples")
    )


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all that is there now and return it as a table in memory (for tests and small results)."""
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
