"""Charging sessions and habits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import first_set, half_up, last_set
from ..functions.time import local_hour
from .energy import energy_aggregates, power_kw, with_kwh
from .spans import in_spans

ACTIVE_KW, APART, LEAST_SECONDS, LEAST_GAIN, DC_KW = 0.05, 14400, 300, 1, 22
SETTLED = 1800


def charge_runs(df: DataFrame, key: str = "vin", t: str = "t") -> DataFrame:
    """(key, start_t, end_t) over the rows that draw power: a new run after APART seconds or when the odometer rose."""
    w = W.partitionBy(key).orderBy(t)
    active = df.where(F.col("chrg") > ACTIVE_KW)
    new = (F.col(t) - F.lag(t).over(w) > APART) | F.coalesce(F.col("odo") > F.lag("odo").over(w), F.lit(False))
    runs = active.withColumn("_run", F.sum(F.coalesce(new.cast("int"), F.lit(0))).over(w))
    return runs.groupBy(key, "_run").agg(F.min(t).alias("start_t"), F.max(t).alias("end_t")).drop("_run")


def detect_charging(df: DataFrame, key: str = "vin", t: str = "t") -> DataFrame:
    """One row per session, over all rows between its first and last active one; with the range shown at its ends if there is a column range_km."""
    span = [key, "start_t", "end_t"]
    rows = in_spans(df, charge_runs(df, key, t), key, t).withColumn("kw", power_kw())
    rows = with_kwh(rows, F.col("kw"), span, t)
    rows = with_kwh(rows, F.col("chrg").cast("double"), span, t, "delivered")
    reach = [first_set("range_km", t).alias("range_start"), last_set("range_km", t).alias("range_end")] if "range_km" in df.columns else []
    out = rows.groupBy(*span).agg(*reach, F.greatest(F.max("chrg"), F.lit(0)).alias("max_kw"), first_set("soc", t).alias("soc_start"), last_set("soc", t).alias("soc_end"), F.coalesce(F.sum("delivered"), F.lit(0.0)).alias("kwh"), *energy_aggregates())
    out = out.withColumn("duration_s", F.col("end_t") - F.col("start_t")).withColumn("soc_gain", F.col("soc_end") - F.col("soc_start"))
    out = out.where((F.col("duration_s") >= LEAST_SECONDS) | F.coalesce(F.col("soc_gain") >= LEAST_GAIN, F.lit(False)))
    avg = F.when(F.col("duration_s") > 0, F.col("kwh") * 3600 / F.col("duration_s"))
    return out.withColumn("avg_kw", avg).withColumn("is_dc", F.col("max_kw") > DC_KW).withColumnRenamed("charged", "kwh_into_pack").drop("discharged", "peak_kw", "peak_regen_kw")


def settled_sessions(sessions: DataFrame, trips: DataFrame, key: str = "vin") -> DataFrame:
    """Sessions with a gain that no trip follows within SETTLED seconds."""
    tr = trips.select(F.col(key).alias("_k"), F.col("start_t").alias("_s"))
    soon = (F.col(key) == F.col("_k")) & (F.col("_s") >= F.col("end_t")) & (F.col("_s") < F.col("end_t") + SETTLED)
    return sessions.where(F.col("soc_gain") >= LEAST_GAIN).join(tr, soon, "left_anti")


def charge_limit(sessions: DataFrame, trips: DataFrame, key: str = "vin") -> DataFrame:
    """(key, charge_limit): the most common level that settled sessions end at, the higher on ties, if three end there and it is below 99."""
    levels = settled_sessions(sessions, trips, key).groupBy(key, half_up(F.col("soc_end")).alias("level")).agg(F.count("*").alias("n"))
    top = levels.groupBy(key).agg(F.max(F.struct("n", "level")).alias("m"))
    return top.select(key, F.when((F.col("m.n") >= 3) & (F.col("m.level") < 99), F.col("m.level")).alias("charge_limit"))


def scheduled_hour(sessions: DataFrame, tz: str, key: str = "vin") -> DataFrame:
    """(key, hour, count, sessions): the most common local start hour, the lowest on ties; null below four sessions, three in that hour or 30 %."""
    hours = sessions.groupBy(key, local_hour("start_t", tz).alias("h")).agg(F.count("*").alias("n"))
    top = hours.groupBy(key).agg(F.max(F.struct(F.col("n"), (-F.col("h")).alias("neg"))).alias("m"), F.sum("n").alias("sessions"))
    n = F.col("m.n")
    hour = F.when((F.col("sessions") >= 4) & (n >= 3) & (n / F.col("sessions") >= 0.3), -F.col("m.neg"))
    return top.select(key, hour.alias("hour"), n.alias("count"), "sessions")


def start_hours(sessions: DataFrame, tz: str, key: str = "vin") -> DataFrame:
    """(key, hour, n) with all 24 hours."""
    dense = sessions.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    n = sessions.groupBy(key, local_hour("start_t", tz).alias("hour")).agg(F.count("*").alias("n"))
    return dense.join(n, [key, "hour"], "left").fillna(0, ["n"])


def charging_summary(sessions: DataFrame, tz: str, key: str = "vin") -> DataFrame:
    """(key, sessions, kwh, dc, ac, max_kw, plug_in_hour, plug_in_count, blips_ignored): the most common local start hour is the lowest on ties; no blip is left out of detect_charging's sessions."""
    total = sessions.groupBy(key).agg(F.count("*").alias("sessions"), F.sum("kwh").alias("kwh"), F.sum(F.col("is_dc").cast("long")).alias("dc"), F.sum((~F.col("is_dc")).cast("long")).alias("ac"), F.max("max_kw").alias("max_kw"))
    hours = sessions.groupBy(key, local_hour("start_t", tz).alias("h")).agg(F.count("*").alias("n"))
    top = hours.groupBy(key).agg(F.max(F.struct(F.col("n"), (-F.col("h")).alias("neg"))).alias("m"))
    return total.join(top, key).select(key, "sessions", "kwh", "dc", "ac", "max_kw", (-F.col("m.neg")).alias("plug_in_hour"), F.col("m.n").alias("plug_in_count"), F.lit(0).alias("blips_ignored"))
