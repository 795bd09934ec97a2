"""Continuous ingest with Structured Streaming: files as they arrive, keyed merges, and windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """Records of the JSON files that arrive in `path`; progress is kept by file, so late rows in new files count."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def deduplicated(stream: DataFrame, keys: list[str], time: str = "ts", delay: str = "7 days") -> DataFrame:
    """One row for each key; keys are forgotten when the watermark has passed them by `delay`."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def counted_by_window(stream: DataFrame, keys: list[str], length: str = "1 day", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Tumbling windows; a window is final when the watermark passes its end."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, length).alias("w"), *keys).agg(F.count("*").alias("count")).select("w.start", "w.end", *keys, "count")


def sessionised(stream: DataFrame, keys: list[str], gap: str = "5 minutes", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Islands of activity; their end is the last event, not the end of the gap."""
    by = stream.withWatermark(time, delay).groupBy(*keys, F.session_window(time, gap).alias("w"))
    return by.agg(F.count("*").alias("events"), F.max(time).alias("last")).select(*keys, F.col("w.start").alias("start"), F.col("last").alias("end"), "events")


def append(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write final rows to Parquet, exactly once by the checkpoint."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
