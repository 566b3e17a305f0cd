"""Streaming extension: sufficient statistics of units and time slots, kept up to date as events arrive.

Sums of 1/ve, z/ve and counts for each (unit, slot) are all that prediction needs of observations, so a stream can
refresh predictions without reading history again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slot_statistics(events: DataFrame, key: Column, ts: str, z: str, ve: Column, slot: str = "1 day", late: str | None = "2 days") -> DataFrame:
    """(start, bau_id, w, wz, n) for each slot; on a stream, events later than ``late`` behind the newest are dropped."""
    e = events.withColumns({"bau_id": key, ts: F.col(ts).cast("timestamp")}).filter("bau_id IS NOT NULL")
    if late and events.isStreaming:
        e = e.withWatermark(ts, late)
    g = e.groupBy(F.window(ts, slot).alias("slot"), "bau_id").agg(F.sum(1 / ve).alias("w"), F.sum(F.col(z) / ve).alias("wz"), F.count(F.lit(1)).alias("n"))
    return g.select(F.col("slot.start").alias("start"), "bau_id", "w", "wz", "n")
