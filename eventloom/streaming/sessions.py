"""Streaming form of time-gap clustering: session windows over a watermark."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from eventloom.operators.sessions import GAP


def session_bounds(events: DataFrame, *keys: str, ts: str = "ts", gap: timedelta = GAP, late: str | None = "1 day") -> DataFrame:
    """Sessions per ``keys``: start_date, end_date, file_count; works on batch and on streaming tables.

    Events exactly ``gap`` apart stay together, as in the batch operator.  For a stream,
    ``late`` is how long a session waits for late events.
    """
    seconds = int(gap.total_seconds())
    rows = events.withColumn("_t", F.col(ts).cast("timestamp"))
    if rows.isStreaming and late:
        rows = rows.withWatermark("_t", late)
    # a window ends, exclusive, one microsecond late, so that a gap of exactly `gap` is bridged
    window = F.session_window("_t", f"{seconds} seconds 1 microsecond")
    return rows.groupBy(*keys, window.alias("_w")).agg(
        F.min(ts).alias("start_date"), F.max(ts).alias("end_date"), F.count("*").alias("file_count")
    ).drop("_w")
