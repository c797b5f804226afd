"""Distributions of driving: histograms, speed profile and top events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .energy import STEP

ABOVE = (50, 100, 120, 130, 150, 180)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, keep: Column | None = None, key: str = "vin") -> DataFrame:
    """(key, bin, left, n), all bins; values outside count in the first and the last one."""
    width = (high - low) / bins
    rows = df.where(F.col(value).isNotNull())
    rows = rows.where(keep) if keep is not None else rows
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(value) - F.lit(low)) / F.lit(width)))).cast("int")
    n = rows.groupBy(key, at.alias("bin")).agg(F.count("*").alias("n"))
    dense = df.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return dense.join(n, [key, "bin"], "left").fillna(0, ["n"]).withColumn("left", F.lit(low) + F.col("bin") * F.lit(width))


def gg_grid(df: DataFrame, longitudinal: str, lateral: str, size: int = 64, extent: float = 0.9, key: str = "vin") -> DataFrame:
    """(key, row, col, n): both accelerations in size x size cells over [-extent, extent); outside is dropped."""
    cell = lambda c: F.floor((F.col(c) + F.lit(extent)) / F.lit(2 * extent) * size).cast("int")
    g = df.select(key, cell(longitudinal).alias("row"), cell(lateral).alias("col")).where(f"row between 0 and {size - 1} and col between 0 and {size - 1}")
    return g.groupBy(key, "row", "col").agg(F.count("*").alias("n"))


def gg_readout(grid: DataFrame, size: int = 64, extent: float = 0.9, key: str = "vin") -> DataFrame:
    """grid with each cell's centre and its share of the vehicle's seconds in percent: (longitudinal, lateral, share, direction, side)."""
    total = grid.groupBy(key).agg(F.sum("n").alias("_total"))
    centre = lambda c: (F.col(c) + 0.5) / size * 2 * extent - extent
    out = grid.join(total, key).withColumn("longitudinal", centre("row")).withColumn("lateral", centre("col")).withColumn("share", F.col("n") / F.col("_total") * 100)
    out = out.withColumn("direction", F.when(F.col("longitudinal") >= 0, "accelerating").otherwise("braking"))
    return out.withColumn("side", F.when(F.col("lateral") >= 0, "left").otherwise("right")).drop("_total")


def best_of(df: DataFrame, by: str, count: int, key: str = "vin", tie: str = "t", descending: bool = True) -> DataFrame:
    """The first `count` rows of each key by a column, nulls last, ties by another; Spark keeps no more than that of each task's rows before the shuffle."""
    order = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    return df.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(order, tie))).where(F.col("place") <= count)


def seconds_above(df: DataFrame, speed: str = "speed", levels=ABOVE, key: str = "vin", t: str = "t") -> DataFrame:
    """(key, level, seconds) where any; the first row counts one second, steps over STEP seconds none."""
    before = F.lag(t).over(W.partitionBy(key).orderBy(t))
    dt = F.when(before.isNull(), F.lit(1)).otherwise(F.col(t) - before)
    rows = df.select(key, F.col(speed).alias("_v"), dt.alias("_dt")).where(f"_dt > 0 and _dt <= {STEP}")
    sums = rows.groupBy(key).agg(*[F.sum(F.when(F.col("_v") >= s, F.col("_dt")).otherwise(0)).alias(str(s)) for s in levels])
    out = sums.unpivot(key, [str(s) for s in levels], "level", "seconds")
    return out.withColumn("level", F.col("level").cast("int")).where("seconds > 0")


def speed_profile(df: DataFrame, speed: str = "speed", key: str = "vin", t: str = "t") -> DataFrame:
    """(key, max_speed, max_speed_t): at least 0, the earliest time."""
    top = df.groupBy(key).agg(F.max_by(t, F.when(F.col(speed) > 0, F.struct(F.col(speed), -F.col(t)))).alias("max_speed_t"), F.greatest(F.coalesce(F.max(speed), F.lit(0)), F.lit(0)).alias("max_speed"))
    return top


def top_events(df: DataFrame, value: str, count: int = 10, sign: int = 1, spacing: int = 60, key: str = "vin", t: str = "t") -> DataFrame:
    """(key, rank, t, value): the best rows at least `spacing` seconds from every better one chosen, ties to the earliest.

    t is unique whole seconds, so a chosen row rules out at most 2 * spacing - 1 others, and the best
    (count - 1) * (2 * spacing - 1) + 1 rows hold all that can be chosen; they are folded in order.
    """
    best = W.partitionBy(key).orderBy((F.col(value) * sign).desc(), F.col(t))
    room = (count - 1) * (2 * spacing - 1) + 1
    rows = df.where(F.col(value).isNotNull()).select(key, t, value).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= room)
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("_r").alias("r"), F.col(t).alias("t"), F.col(value).cast("double").alias("v")))).alias("_l"))
    start = F.array().cast("array<struct<r:int,t:bigint,v:double>>")
    pick = F.aggregate("_l", start, lambda acc, x: F.when((F.size(acc) < count) & F.forall(acc, lambda y: F.abs(y["t"] - x["t"]) >= spacing), F.array_append(acc, x)).otherwise(acc))
    out = lists.select(key, F.posexplode(pick).alias("_p", "_e"))
    return out.select(key, (F.col("_p") + 1).alias("rank"), F.col("_e.t").alias(t), F.col("_e.v").alias("value"))


def in_trip(events: DataFrame, trips: DataFrame, key: str = "vin", t: str = "t") -> DataFrame:
    """events with trip_start_t of the trip that holds them, else null; trips are disjoint, so the last one begun is the only candidate."""
    marks = trips.select(F.col(key), F.col("start_t").alias(t), F.col("start_t").alias("_s"), F.col("end_t").alias("_e"), F.lit(0).alias("_kind"))
    both = events.withColumn("_kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(t, "_kind").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("_last", F.last("_s", True).over(w)).withColumn("_until", F.last("_e", True).over(w))
    found = F.when(F.col(t) <= F.col("_until"), F.col("_last"))
    return both.where("_kind = 1").withColumn("trip_start_t", found).select(*events.columns, "trip_start_t")
