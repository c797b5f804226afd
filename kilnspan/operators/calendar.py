"""Roll-ups by local day, hour and weekday."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import day_start, local_date, local_hour, weekday


def calendar_days(df: DataFrame, tz: str, key: str = "vin", t: str = "t") -> DataFrame:
    """(key, day): the local dates met in steps of half a day from the first instant to half a day after the last; the last one may be empty."""
    ends = df.groupBy(key).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    steps = ends.select(key, F.explode(F.expr("sequence(_a, _b + 43200, 43200)")).alias("_s"))
    return steps.select(key, local_date("_s", tz).alias("day")).distinct()


def day_buckets(df: DataFrame, trips: DataFrame, sessions: DataFrame, windows: DataFrame, tz: str, key: str = "vin", t: str = "t") -> DataFrame:
    """One row per calendar day: trips and charging by their start day, state of charge by sample day, and whether a coverage window touches it."""
    days = calendar_days(df, tz, key, t)
    by = lambda x: x.withColumn("day", local_date("start_t", tz)).groupBy(key, "day")
    tr = by(trips).agg(F.sum("km").alias("km"), F.sum("moving_s").alias("moving_s"), F.count("*").alias("trips"), F.max("max_speed").alias("max_speed"), F.sum(F.col("discharged") - F.col("charged")).alias("net_kwh"))
    ch = by(sessions).agg(F.sum("kwh").alias("charged_kwh"))
    soc = df.withColumn("day", local_date(t, tz)).groupBy(key, "day").agg(F.min("soc").alias("soc_min"), F.max("soc").alias("soc_max"))
    out = days.join(tr, [key, "day"], "left").join(ch, [key, "day"], "left").join(soc, [key, "day"], "left")
    out = out.fillna(0, ["km", "moving_s", "trips", "max_speed", "net_kwh", "charged_kwh"])
    return out.join(covered_days(windows, tz, key).withColumn("covered", F.lit(True)), [key, "day"], "left").fillna(False, ["covered"])


def covered_days(windows: DataFrame, tz: str, key: str = "vin") -> DataFrame:
    """(key, day): the local days, of 86,400 seconds from their start, that a window touches. Windows are dealt out by day, so days meet only their own."""
    near = F.sequence(F.date_sub(local_date("start_t", tz), 1), F.date_add(local_date("end_t", tz), 1))
    days = windows.select(key, "start_t", "end_t", F.explode(near).alias("day")).withColumn("_start", day_start("day", tz))
    return days.where((F.col("start_t") < F.col("_start") + 86400) & (F.col("end_t") > F.col("_start"))).select(key, "day").distinct()


def punchcard(trips: DataFrame, tz: str, key: str = "vin") -> DataFrame:
    """(key, weekday, hour, seconds), all 168 cells: trips walked in steps of five minutes."""
    steps = trips.select(key, "end_t", F.explode(F.sequence("start_t", "end_t", F.lit(300).cast("long"))).alias("_s"))
    cells = steps.groupBy(key, weekday("_s", tz).alias("weekday"), local_hour("_s", tz).alias("hour")).agg(F.sum(F.least(F.lit(300).cast("long"), F.col("end_t") - F.col("_s") + 1)).alias("seconds"))
    dense = trips.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(167))).alias("_c")).select(key, F.floor(F.col("_c") / 24).cast("int").alias("weekday"), (F.col("_c") % 24).alias("hour"))
    return dense.join(cells, [key, "weekday", "hour"], "left").fillna(0, ["seconds"])
