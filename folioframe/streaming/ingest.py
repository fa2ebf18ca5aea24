"""Files that arrive: each new one is read once and its rows appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arrivals(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of path, length, modificationTime and sha256 of new files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def ingest_once(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append everything that is new since the last call, then stop."""
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts of event types by tumbling windows, late rows up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
