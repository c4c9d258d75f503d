"""Structured Streaming front: list-mode files to a histogram for each dynamic frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomoframe.operators.temporal import assign_frames


def frame_histogram(stream: DataFrame, frames: DataFrame, lateness_ms: int | None = None) -> DataFrame:
    """(frame, d1, d2, value) of a stream or table of list-mode rows.

    Frames are searched in an expression, so the stream needs no join state.
    With lateness_ms the rows also get an event time and a watermark, and the
    histogram is kept per day window, which lets old state go.
    """
    e = assign_frames(stream, frames).where("frame >= 0").withColumns({"a": F.least("d1", "d2"), "b": F.greatest("d1", "d2")})
    keys = ["frame", F.col("a").alias("d1"), F.col("b").alias("d2")]
    if lateness_ms is not None:
        e = e.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", f"{lateness_ms} milliseconds")
        keys.append(F.window("event_time", "1 day"))
    return e.groupBy(*keys).agg(F.count("*").cast("double").alias("value"))
