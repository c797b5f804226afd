"""Power and energy over spans of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Steps longer than this many seconds carry no energy.
STEP = 10


def power_kw(volt: str = "volt", curr: str = "curr") -> Column:
    return F.col(volt) * F.col(curr) / F.lit(1000.0)


def with_kwh(df: DataFrame, value: Column, span: list[str], t: str = "t", name: str = "kwh") -> DataFrame:
    """The trapezoid from the row before, if both have a value and lie 1 to STEP seconds apart."""
    w = W.partitionBy(*span).orderBy(t)
    v = df.withColumn("_v", value)
    dt = F.col(t) - F.lag(t).over(w)
    return v.withColumn(name, F.when((dt > 0) & (dt <= STEP), (F.col("_v") + F.lag("_v").over(w)) / 2 * dt / 3600)).drop("_v")


def energy_aggregates(kwh: str = "kwh", power: str = "kw") -> list[Column]:
    """Discharged and charged kWh by the sign of each step, and peak power both ways, at least 0."""
    k, p = F.col(kwh), F.col(power)
    return [
        F.coalesce(F.sum(F.when(k >= 0, k)), F.lit(0.0)).alias("discharged"),
        F.coalesce(F.sum(F.when(k < 0, -k)), F.lit(0.0)).alias("charged"),
        F.greatest(F.coalesce(F.max(p), F.lit(0.0)), F.lit(0.0)).alias("peak_kw"),
        F.greatest(F.coalesce(-F.min(p), F.lit(0.0)), F.lit(0.0)).alias("peak_regen_kw"),
    ]


def integrate_energy(df: DataFrame, span: list[str], volt: str = "volt", curr: str = "curr", t: str = "t") -> DataFrame:
    p = df.withColumn("kw", power_kw(volt, curr))
    return with_kwh(p, F.col("kw"), span, t).groupBy(*span).agg(*energy_aggregates())


def integrate_signal(df: DataFrame, signal: str, span: list[str], t: str = "t") -> DataFrame:
    return with_kwh(df, F.col(signal).cast("double"), span, t).groupBy(*span).agg(F.coalesce(F.sum("kwh"), F.lit(0.0)).alias("kwh"))
