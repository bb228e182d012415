"""Counts of positions by zone and time window over a stream, late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.operators.joins import points_in_regions


def zone_counts(events: DataFrame, zones: DataFrame, time: str = "ts", zone: str = "zone", window: str = "1 hour", late: str = "2 hours", x: str = "lon", y: str = "lat") -> DataFrame:
    """Works on streams and tables alike: zones are a fixed table on the other side of a cell join."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    hits = points_in_regions(timed, zones.select(zone, "geom"), x, y)
    return hits.groupBy(F.window(time, window), zone).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", zone, "n")
