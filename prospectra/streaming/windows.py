"""Windowed totals of event streams; the same functions take a table, whose result a drained stream reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream's watermark needs timestamps with a zone; a table's stay as they are, whatever the session's zone."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def tumbling(events: DataFrame, key: str, value: str, time: str = "ts", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(key, began, n, total) of each key and window; rows later than `late` behind the newest are left out of a stream."""
    w = F.window(time, width)
    totals = _timed(events, time, late).groupBy(key, w).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return totals.select(key, F.col("window.start").alias("began"), "n", "total")


def sessions(events: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(key, began, n) of each run of a key's events in which no two neighbours are `gap` or more apart."""
    w = F.session_window(time, gap)
    found = _timed(events, time, late).where(F.col(key).isNotNull()).groupBy(key, w).agg(F.count("*").alias("n"))
    return found.select(key, F.col("session_window.start").alias("began"), "n")


def first_seen(events: DataFrame, key: str, time: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once, though sources send it again within `late`."""
    return _timed(events, time, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
