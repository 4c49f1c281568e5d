"""Bursts over a stream: the session rule of the batch operator, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_bursts(rows: DataFrame, scene: str, time: str, gap: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """One row for each burst of a scene: frames, start, end (of the last frame).

    A session window reaches one gap beyond its last frame, and a frame that comes exactly a gap later still belongs to it, as in the batch
    rule. Works on streams (append mode: a burst appears once the watermark has passed it) and on batches.
    """
    watched = rows.withWatermark(time, late) if rows.isStreaming else rows
    grouped = watched.groupBy(scene, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("frames"), F.min(time).alias("start"), F.max(time).alias("end"))
    return grouped.select(scene, "frames", "start", "end")
