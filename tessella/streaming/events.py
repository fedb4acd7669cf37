"""Event streams: windowed counts with watermarks, rolling route summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.observe import route_summary


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and their summed values per window and type; works on streams and on tables.

    A stream needs a time with a zone, so times without one are read as UTC (the session's zone).
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return (
        timed.groupBy(F.window("ts", size).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("total"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")
    )


def session_counts(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Events per user session: a session ends after ``gap`` without an event."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n"
    )


def run_once(spark: SparkSession, stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Process all that is there now and return the sink's table (memory sink: for small results)."""
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.table(name)


def rolling_summary(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Route summary per hour over a stream of route events."""
    timed = events.withWatermark("timestamp", late).withColumn("hour", F.window("timestamp", "1 hour")["start"])
    return route_summary(timed, ("hour", "route"))
