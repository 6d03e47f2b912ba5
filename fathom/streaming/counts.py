"""Counts by event-time window as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, kind: str, time: str, value: str, width: str = "1 day", delay: str = "1 day", limit: int = 10) -> DataFrame:
    """begin and end of each window, kind, n, total of the values in hundredths, and over_limit; a window is told once the watermark has passed its end.

    The watermark stays delay behind the newest event; older events are left out.
    """
    rows = events.withWatermark(time, delay).groupBy(F.window(time, width), kind)
    counted = rows.agg(F.count("*").alias("n"), F.sum(F.round(F.col(value) * 100).cast("long")).alias("hundredths"))
    return counted.select(F.col("window.start").alias("begin"), F.col("window.end").alias("end"), kind, "n", "hundredths", (F.col("n") > limit).alias("over_limit"))
