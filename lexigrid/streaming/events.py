"""Windows, sessions and resumable appends; each works on tables and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """``(event_type, hour, n, n_users)`` by window of ``ts``; on a stream the user count is approximate."""
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    users = F.approx_count_distinct("user_id") if events.isStreaming else F.countDistinct("user_id")
    return rows.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), users.alias("n_users")).select("event_type", F.col("w.start").alias("hour"), "n", "n_users")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """``(user_id, start, end, n)``: runs of a user's events that are less than ``gap`` apart."""
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append_new(stream: DataFrame, key: str, late: str, time_col: str, path: str, checkpoint: str):
    """Append a stream's rows to a table, each key once within ``late``; restarts go on where they stopped."""
    rows = stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark([key])
    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
