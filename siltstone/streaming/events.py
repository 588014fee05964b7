"""Event-time operators that run alike on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events and totals by kind and day; on a stream, days close once the watermark passes them."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).select(
        "event_type", F.col("w.start").alias("day"), "events", "total"
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select(
        "user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "events"
    )


def once(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
