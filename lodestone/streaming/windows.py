"""Watermarked windows and sessions over events, as one plan for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts, sums and least values by window and type; rows later than the watermark are left out of a stream."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("best"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total", "best")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), "user_id")
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New Parquet files of a folder as a stream of events."""
    return spark.readStream.schema(EVENTS).parquet(folder)
