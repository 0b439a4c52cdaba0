"""Event counts on fixed frames and sessions of events, over unbounded input with bounded state.

Frames here are windows [start, start + length): an event belongs to the frame it falls into, not to the
nearest one, as a window can't reach back; late events beyond the watermark are dropped by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def framed_events(events: DataFrame, frame: str = "1 hour", delay: str = "1 hour", value: str = "value") -> DataFrame:
    """(recording_id, start, n, total) of events (recording_id, ts, value) by fixed windows."""
    counts = events.withWatermark("ts", delay).groupBy("recording_id", F.window("ts", frame))
    return counts.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select("recording_id", F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(recording_id, start, end, n) of runs of events without a pause of gap."""
    runs = events.withWatermark("ts", delay).groupBy("recording_id", F.session_window("ts", gap))
    return runs.agg(F.count("*").alias("n")).select("recording_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
