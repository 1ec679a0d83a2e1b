"""Extension: event-time windows over a stream of files, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, ts: str, by: list[str], value: str, width: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums a window and group; works alike on a stream and on a table."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, by: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Rows of a group no further apart than the gap, as one session."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def read_stream(spark: SparkSession, folder: str, schema, kind: str = "parquet", glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, written as Parquet; windows that the watermark has closed are final."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
