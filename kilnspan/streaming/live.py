"""Awake spans and day totals of rows that still arrive, beyond what the recorded analysis needs.

Both are the batch operators' rules over a stream: state is one open span or day by vehicle, and ends with the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import local_date


def live_awake_spans(stream: DataFrame, late: str = "10 minutes", gap: int = 60, key: str = "vin", t: str = "t") -> DataFrame:
    """(key, start_t, end_t, rows) of each awake span, once no row of it can come any more; rows later than `late` are left out."""
    timed = stream.withColumn("_ts", F.timestamp_seconds(t)).withWatermark("_ts", late)
    spans = timed.groupBy(key, F.session_window("_ts", f"{gap} seconds")).agg(F.min(t).alias("start_t"), F.max(t).alias("end_t"), F.count("*").alias("rows"))
    return spans.select(key, "start_t", "end_t", "rows")


def live_days(stream: DataFrame, value: str, tz: str, late: str = "1 day", key: str = "vin", t: str = "t") -> DataFrame:
    """(key, day, low, high, rows) by local day of rows within the watermark, for update mode; a day ends once the watermark has passed the hours around it."""
    timed = stream.withColumn("_ts", F.timestamp_seconds(t)).withWatermark("_ts", late).withColumn("day", local_date(t, tz))
    days = timed.groupBy(key, "day", F.window("_ts", "1 day")).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("rows"))
    return days.select(key, "day", F.col("window.start").alias("part"), "low", "high", "rows")
