"""Trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import first_set, last_set
from .energy import STEP, energy_aggregates, power_kw, with_kwh
from .spans import in_spans, with_awake

#: A trip ends when a row that does not drive comes this many seconds after the last one that does; shorter and nearer trips are none.
STOP, LEAST_SECONDS, LEAST_KM = 120, 30, 0.2


def driving(gear: str = "gear", speed: str = "speed") -> Column:
    """Gear D, N or R, or any speed."""
    return F.coalesce(F.col(gear).isin(1, 2, 3), F.lit(False)) | F.coalesce(F.col(speed) > 0, F.lit(False))


def with_trips(df: DataFrame, stop: int = STOP, gap: int = 60, key: str = "vin", t: str = "t") -> DataFrame:
    """Rows between the first and last driving row of a trip candidate, with start_t and end_t.

    All windows but the first (awake spans) are by awake span, so one vehicle's rows spread over tasks.
    """
    rows = with_awake(df, gap, key, t).withColumn("_drv", driving())
    span = W.partitionBy(key, "aw").orderBy(t)
    before = span.rowsBetween(W.unboundedPreceding, -1)
    last = F.max(F.when(F.col("_drv"), F.col(t))).over(before)
    new = F.col("_drv") & (last.isNull() | (F.lag(t).over(span) - last >= stop))
    rows = rows.withColumn("_trip", F.sum(new.cast("int")).over(span)).where("_trip > 0")
    trip = W.partitionBy(key, "aw", "_trip")
    rows = rows.withColumn("start_t", F.min(t).over(trip)).withColumn("end_t", F.max(F.when(F.col("_drv"), F.col(t))).over(trip))
    return rows.where(F.col(t) <= F.col("end_t")).drop("_drv", "_trip")


def detect_trips(df: DataFrame, key: str = "vin", t: str = "t") -> DataFrame:
    """One row per trip with its distance, times, speeds, state of charge, energy and peak accelerations (of accel and lateral, at least 0).

    Without an odometer column distances are null and no trip is too short in km; without accelerations their peaks are null.
    """
    rows = with_trips(df, key=key, t=t).withColumn("kw", power_kw())
    span = [key, "start_t", "end_t"]
    rows = with_kwh(rows, F.col("kw"), span, t)
    dt = F.col(t) - F.lag(t).over(W.partitionBy(*span).orderBy(t))
    rows = rows.withColumn("_move", F.when((F.col("speed") > 0) & (dt > 0) & (dt <= STEP), dt))
    has_odo = "odo" in df.columns
    odo = [first_set("odo", t).alias("odo0"), last_set("odo", t).alias("odo1")] if has_odo else [F.lit(None).cast("double").alias("odo0"), F.lit(None).cast("double").alias("odo1")]
    floored = lambda c, name: (F.greatest(F.coalesce(F.max(c), F.lit(0.0)), F.lit(0.0)) if name in df.columns else F.lit(None).cast("double"))
    peaks = [floored(F.col("accel"), "accel").alias("peak_accel"), floored(-F.col("accel"), "accel").alias("peak_brake"), floored(F.abs(F.col("lateral")), "lateral").alias("peak_lateral")]
    fast = F.when(F.col("speed") > 0, F.struct(F.col("speed"), -F.col(t)))
    out = rows.groupBy(*span).agg(
        F.coalesce(F.sum("_move"), F.lit(0)).alias("moving_s"), F.greatest(F.coalesce(F.max("speed"), F.lit(0)), F.lit(0)).alias("max_speed"), F.max_by(t, fast).alias("max_speed_t"), first_set("soc", t).alias("soc_start"), last_set("soc", t).alias("soc_end"), *odo, *energy_aggregates(), *peaks
    )
    out = out.withColumn("duration_s", F.col("end_t") - F.col("start_t")).where(F.col("duration_s") >= LEAST_SECONDS)
    if has_odo:
        out = out.where(F.col("odo1") - F.col("odo0") >= LEAST_KM)
    km = F.greatest(F.col("odo1") - F.col("odo0"), F.lit(0))
    gross = F.col("discharged") + F.col("charged")
    return (
        out.withColumn("km", km.cast("double"))
        .withColumn("max_speed_t", F.coalesce("max_speed_t", "start_t"))
        .withColumn("avg_speed", F.when(F.col("moving_s") > 0, F.col("km") / F.col("moving_s") * 3600))
        .withColumn("regen_share", F.when(gross > 0, F.col("charged") / gross))
        .withColumn("kwh_100km", F.when(F.col("km") >= 1, (F.col("discharged") - F.col("charged")) / F.col("km") * 100))
        .drop("odo0", "odo1")
    )


def sorted_trips(trips: DataFrame, by: str, descending: bool = True) -> DataFrame:
    """Nulls last either way."""
    return trips.orderBy(F.desc_nulls_last(by) if descending else F.asc_nulls_last(by), "start_t")


def slices(df: DataFrame, spans: DataFrame, signals: dict[str, Column], key: str = "vin", t: str = "t") -> DataFrame:
    """(key, start_t, signal, t, value): what the panels of each trip or session show, from its first row to its last.

    signals: an expression by name. A signal without any reading in the whole of a vehicle's rows has no panel; else its empty rows are kept as nulls.
    """
    named = df.select(key, t, *[c.cast("double").alias(n) for n, c in signals.items()])
    some = named.groupBy(key).agg(*[F.count(n).alias(n) for n in signals]).unpivot(key, list(signals), "signal", "_n").where("_n > 0").drop("_n")
    rows = in_spans(named, spans, key, t).unpivot([key, "start_t", t], list(signals), "signal", "value")
    return rows.join(some, [key, "signal"], "left_semi").select(key, "start_t", "signal", t, "value")
