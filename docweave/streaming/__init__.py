"""Streams as collections.

A streaming DataFrame can be registered in the catalog like a table. Filters,
projections and joins with static collections are planned as for tables; the
result is a streaming DataFrame to be written with ``writeStream``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_count(stream: DataFrame, time_col: str, window: str, watermark: str, keys: list[str] | None = None, slide: str | None = None) -> DataFrame:
    """Rows in each window of event time, and key. Rows later than ``watermark`` are left
    out, and a window's state is dropped once it can't change."""
    span = F.window(F.col(time_col).cast("timestamp"), window, slide) if slide else F.window(F.col(time_col).cast("timestamp"), window)
    timed = stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, watermark)
    return timed.groupBy(span.alias("window"), *(keys or [])).agg(F.count("*").alias("count")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(keys or []), "count")
