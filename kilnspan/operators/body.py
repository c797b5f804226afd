"""Doors and tyres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import correlation, nth_values
from ..functions.time import local_date, local_hour, weekday
from .battery import stride_sample


def door_events(df: DataFrame, doors: list[str], key: str = "vin", t: str = "t") -> DataFrame:
    """(key, door, t, open_s): a door opens at 1 after 0 (or at first) and closes at the next 0; open_s is null if it never does."""
    long = df.select(key, t, *[F.col(d).cast("int").alias(d) for d in doors]).unpivot([key, t], doors, "door", "v").where("v is not null")
    w = W.partitionBy(key, "door").orderBy(t)
    edges = long.withColumn("_p", F.lag("v", 1, 0).over(w)).where("(v = 1) <> (_p = 1)")
    return edges.withColumn("open_s", F.lead(t).over(w) - F.col(t)).where("v = 1").select(key, "door", t, "open_s")


def door_grid(events: DataFrame, tz: str, key: str = "vin", t: str = "t") -> DataFrame:
    return events.groupBy(key, weekday(t, tz).alias("weekday"), local_hour(t, tz).alias("hour")).agg(F.count("*").alias("n"))


def busiest_hour(events: DataFrame, tz: str, key: str = "vin", t: str = "t") -> DataFrame:
    """(key, hour, n): the lowest hour on ties."""
    n = events.groupBy(key, local_hour(t, tz).alias("h")).agg(F.count("*").alias("c"))
    top = n.groupBy(key).agg(F.max(F.struct(F.col("c"), (-F.col("h")).alias("neg"))).alias("m"))
    return top.select(key, (-F.col("m.neg")).alias("hour"), F.col("m.c").alias("n"))


def quiet_hours(events: DataFrame, tz: str, key: str = "vin", t: str = "t") -> DataFrame:
    """(key, hour): the hours of the day without any event, for vehicles that have some."""
    slots = events.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return slots.join(events.select(key, local_hour(t, tz).alias("hour")).distinct(), [key, "hour"], "left_anti")


def per_door(df: DataFrame, events: DataFrame, doors: list[str], key: str = "vin") -> DataFrame:
    """(key, door, n): how often each door opened; 0 for one that reports but never did, no row for one that does not report."""
    reports = df.select(key, *[F.col(d).cast("int").alias(d) for d in doors]).unpivot(key, doors, "door", "v").where("v is not null").select(key, "door").distinct()
    n = events.groupBy(key, "door").agg(F.count("*").alias("n"))
    return reports.join(n, [key, "door"], "left").fillna(0, ["n"])


def longest_open(events: DataFrame, key: str = "vin", t: str = "t") -> DataFrame:
    """(key, door, t, open_s): the door event that lasted longest, the earliest on ties; those that never closed do not count."""
    best = F.max(F.struct(F.col("open_s"), (-F.col(t)).alias("neg"), F.col("door"))).alias("m")
    return events.where("open_s is not null").groupBy(key).agg(best).select(key, F.col("m.door").alias("door"), (-F.col("m.neg")).alias(t), F.col("m.open_s").alias("open_s"))


def quiet_stretch(hours: DataFrame, key: str = "vin") -> DataFrame:
    """(key, from_h, to_h, hours): the longest circular run of hours without events in (key, hour), the earliest longest, at most 24."""
    busy = hours.select(key, "hour").distinct().withColumn("_b", F.lit(1))
    slots = hours.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(47))).alias("slot")).withColumn("hour", F.col("slot") % 24)
    quiet = slots.join(busy, [key, "hour"], "left").where("_b is null")
    w = W.partitionBy(key).orderBy("slot")
    runs = quiet.withColumn("_i", F.col("slot") - F.row_number().over(w)).groupBy(key, "_i").agg(F.min("slot").alias("a"), F.least(F.lit(24), F.count("*")).alias("n"))
    top = runs.groupBy(key).agg(F.max(F.struct(F.col("n"), (-F.col("a")).alias("neg"))).alias("m"))
    first = -F.col("m.neg")
    return top.select(key, (first % 24).cast("int").alias("from_h"), ((first + F.col("m.n")) % 24).cast("int").alias("to_h"), F.col("m.n").cast("int").alias("hours"))


def tyre_days(df: DataFrame, wheels: list[str], temp: str | None, tz: str, stride: int = 300, key: str = "vin", t: str = "t") -> DataFrame:
    """(key, day, wheels..., temp): upper medians of rows sampled every `stride` seconds from each local day's first row."""
    columns = [*wheels, *([temp] if temp else [])]
    rows = df.select(key, t, *columns).withColumn("day", local_date(t, tz))
    return nth_values(stride_sample(rows, stride, [key, "day"], t), [key, "day"], [(c, 0.5, c) for c in columns])


def tyre_drift(days: DataFrame, wheels: list[str], key: str = "vin") -> DataFrame:
    """(key, wheel_drift...): the last day less the first one, of the days with any reading."""
    some = days.where(F.coalesce(*wheels).isNotNull())
    return some.groupBy(key).agg(*[(F.max_by(c, "day") - F.min_by(c, "day")).alias(f"{c}_drift") for c in wheels])


def tyre_weather(days: DataFrame, wheels: list[str], temp: str, key: str = "vin") -> DataFrame:
    """(key, r): correlation of the day's temperature and the upper median of its wheels."""
    values = F.sort_array(F.array_compact(F.array(*wheels)))
    mid = F.try_element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))
    return days.withColumn("_m", mid.cast("double")).withColumn("_t", F.col(temp).cast("double")).groupBy(key).agg(correlation("_m", "_t").alias("r"))
