"""The header of an analysis and the ranked facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import duration_label, moment_label, number_label
from ..functions.numbers import half_up
from ..functions.time import hour_label, local_date, local_hour
from .body import busiest_hour
from .calendar import calendar_days, covered_days
from .spans import awake_spans, span_seconds
from .style import seconds_above


def header(df: DataFrame, windows: DataFrame, tz: str, sources: DataFrame | None = None, key: str = "vin", t: str = "t") -> DataFrame:
    """(key, window_days, rows, coverage_s, recorded_s, recorded_days, sources, odo_start, odo_end); windows are coalesced.

    recorded_days are the calendar days that a window touches; sources (key, n) the recordings behind the rows, 1 where none are named.
    """
    base = df.groupBy(key).agg(F.min(t).alias("_a"), F.max(t).alias("_b"), F.count("*").alias("rows"), F.min("odo").alias("odo_start"), F.max("odo").alias("odo_end"))
    awake = span_seconds(awake_spans(df, key=key, t=t), key).select(key, F.col("seconds").alias("coverage_s"))
    rec = windows.groupBy(key).agg(F.greatest(F.lit(1), F.sum(F.col("end_t") - F.col("start_t"))).alias("recorded_s"))
    touched = covered_days(windows, tz, key).join(calendar_days(df, tz, key, t), [key, "day"], "left_semi").groupBy(key).agg(F.count("*").alias("recorded_days"))
    days = F.greatest(F.lit(1), half_up((F.col("_b") - F.col("_a")) / 86400))
    out = base.join(awake, key).join(rec, key).join(touched, key, "left").fillna(0, ["recorded_days"]).withColumn("window_days", days).drop("_a", "_b")
    return out.join(sources.select(key, F.col("n").alias("sources")), key, "left").fillna(1, ["sources"]) if sources is not None else out.withColumn("sources", F.lit(1))


def overview(df: DataFrame, trips: DataFrame, sessions: DataFrame, price: float = 0.32, key: str = "vin", t: str = "t") -> DataFrame:
    """(key, km, moving_s, kwh, kwh_100km, cost, soc_min, soc_max, signals, seconds_fast): the figures above the charts.

    kwh_100km is the energy charged over the distance driven, cost its price, signals the columns with any reading and seconds_fast the time at 100 km/h or more.
    """
    tr = trips.groupBy(key).agg(F.sum("km").alias("km"), F.sum("moving_s").alias("moving_s"))
    ch = sessions.groupBy(key).agg(F.sum("kwh").alias("kwh"))
    fast = seconds_above(df, levels=(100,), key=key, t=t).select(key, F.col("seconds").alias("seconds_fast"))
    own = [c for c in df.columns if c not in (key, t, "vmodel")]
    base = df.groupBy(key).agg(F.min("soc").alias("soc_min"), F.max("soc").alias("soc_max"), sum((F.when(F.count(c) > 0, 1).otherwise(0) for c in own), F.lit(0)).alias("signals"))
    out = reduce(lambda a, b: a.join(b, key, "left"), [base, tr, ch, fast]).fillna(0, ["km", "moving_s", "kwh", "seconds_fast"])
    return out.withColumn("kwh_100km", F.try_divide(F.col("kwh"), F.col("km")) * 100).withColumn("cost", F.col("kwh") * price)


def _extras(given: dict[str, DataFrame], key: str) -> list[DataFrame]:
    """A row per vehicle of each optional table of ranked()."""
    lost = F.sum("soc_lost") / F.sum("hours") * 24
    made = {
        "brakes": lambda x: x.groupBy(key).agg(F.max(F.abs("value")).alias("brake")),
        "schedule": lambda x: x.select(key, F.col("hour").alias("scheduled")),
        "limit": lambda x: x.select(key, F.col("charge_limit").alias("limit")),
        "days": lambda x: x.groupBy(key).agg(F.sum(F.when(F.col("covered") & (F.col("km") == 0), 1).otherwise(0)).alias("idle")),
        "drain": lambda x: x.groupBy(key).agg(lost.alias("drain"), F.count("*").alias("drains")),
        "full_range": lambda x: x.select(key, F.col("p50").alias("range")),
        "doors": lambda x: x.groupBy(key).agg(F.count("*").alias("opened")),
        "empty": lambda x: x.groupBy(key).agg(F.count("*").alias("blank")),
        "report": lambda x: x.groupBy(key).agg(F.sum("rows").alias("parsed"), F.sum("duplicates").alias("repeated")),
        "thermal": lambda x: x.select(key, F.col("spread")),
        "tyres": lambda x: x.select(key, F.col("r").alias("weather")),
    }
    if unknown := set(given) - set(made):
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    return [made[name](x) for name, x in given.items()]


def ranked(df: DataFrame, trips: DataFrame, sessions: DataFrame, tz: str, key: str = "vin", **more: DataFrame) -> DataFrame:
    """(key, ord, id, tone, value) of the facts that hold; values that need a phrase are left to the reader.

    more names further tables, whose facts are left out without them: brakes (top_events), schedule (scheduled_hour), limit (charge_limit),
    days (day_buckets), drain (phantom_drain), full_range (implied_range), doors (door_events), empty (empty_columns), report (order_report),
    thermal (pack_thermal) and tyres (tyre_weather).
    """
    hours = trips.select(key, local_hour("start_t", tz).alias("_h"))
    peaks = hours.groupBy(key).agg(F.sum(F.col("_h").between(5, 9).cast("long")).alias("morning"), F.sum(F.col("_h").between(15, 19).cast("long")).alias("evening"))
    t = trips.groupBy(key).agg(F.sum("km").alias("km"), F.sum("moving_s").alias("moving"), F.max("max_speed").alias("fast"), F.max("km").alias("long"), F.count("*").alias("trips"))
    s = sessions.groupBy(key).agg(F.sum("kwh").alias("kwh"), F.max(F.col("is_dc").cast("int")).alias("dc"), F.max("max_kw").alias("kw"), F.count("*").alias("sessions"))
    hour = busiest_hour(trips, tz, key, "start_t").select(key, "hour")
    plug = busiest_hour(sessions, tz, key, "start_t").select(key, F.col("hour").alias("plugged"))
    day = trips.groupBy(key, local_date("start_t", tz).alias("_d")).agg(F.sum("km").alias("_km")).groupBy(key).agg(F.max("_km").alias("busiest"))
    n = df.groupBy(key).agg(F.count("*").alias("samples"))
    base = reduce(lambda a, b: a.join(b, key, "left"), [n, t, s, hour, peaks, plug, day, *_extras(more, key)])
    c = lambda name: F.col(name) if name in base.columns else F.lit(None).cast("double")
    both = c("morning") + c("evening")
    some_doors = c("opened") > 0
    rules: list[tuple[str, str, Column, Column]] = [
        ("distance", "headline", c("km") > 0, c("km")),
        ("time-driving", "headline", c("moving") > 0, c("moving")),
        ("top-speed", "headline", c("fast") > 0, c("fast")),
        ("longest-trip", "headline", c("long").isNotNull(), c("long")),
        ("hardest-brake", "headline", c("brake").isNotNull(), c("brake")),
        ("energy-charged", "headline", c("kwh") > 0, c("kwh")),
        ("departure-rhythm", "habit", c("trips") >= 4, c("hour")),
        ("commute-shape", "habit", (c("trips") >= 4) & (c("morning") >= 5) & (c("evening") >= 5) & (both > c("trips") * 0.5), both),
        ("scheduled-charging", "habit", c("scheduled").isNotNull(), c("scheduled")),
        ("plug-in-habit", "habit", c("scheduled").isNull() & (c("sessions") >= 5), c("plugged")),
        ("charge-limit", "habit", c("limit").isNotNull(), c("limit")),
        ("ac-only", "habit", (c("sessions") > 0) & (c("dc") == 0), c("kw")),
        ("idle-days", "habit", c("idle") > 0, c("idle")),
        ("busiest-day", "habit", c("busiest") > 0, c("busiest")),
        ("phantom-drain", "habit", c("drains") > 2, c("drain")),
        ("implied-range", "habit", c("range").isNotNull(), c("range")),
        ("door-rhythm", "habit", some_doors, c("opened")),
        ("sample-count", "quirk", F.lit(True), c("samples")),
        ("empty-columns", "quirk", c("blank") > 0, c("blank")),
        ("duplicate-rows", "quirk", c("repeated") > 0, c("repeated")),
        ("beijing-time", "quirk", F.lit(True), F.lit(18)),
        ("pack-spread", "quirk", c("spread") > 0, c("spread")),
        ("tyre-weather", "quirk", F.abs(c("weather")) > 0.3, c("weather")),
        ("no-gps", "privacy", F.lit(True), F.lit(None)),
        ("vin-repetition", "privacy", c("parsed").isNotNull() & (F.col(key).cast("string") != ""), c("parsed")),
        ("routine-exposure", "privacy", some_doors, c("opened")),
        ("second-resolution", "privacy", F.lit(True), F.lit(1)),
    ]
    row = lambda k, r: F.when(F.coalesce(r[2], F.lit(False)), F.struct(F.lit(k).alias("ord"), F.lit(r[0]).alias("id"), F.lit(r[1]).alias("tone"), r[3].cast("double").alias("value")))
    found = F.array_compact(F.array(*[row(k, r) for k, r in enumerate(rules)]))
    return base.select(key, F.explode(found).alias("f")).select(key, "f.*")


#: How a fact's value reads: an expression of it, and what stands after it.
_SHOWN = {
    "distance": (number_label, " km driven"),
    "time-driving": (duration_label, " at the wheel"),
    "top-speed": (number_label, " km/h at most"),
    "longest-trip": (number_label, " km without a stop"),
    "hardest-brake": (lambda v: number_label(v, 2), " g of braking"),
    "energy-charged": (number_label, " kWh charged"),
    "departure-rhythm": (hour_label, " is the usual start"),
    "commute-shape": (number_label, " trips look like a way to work"),
    "scheduled-charging": (hour_label, " starts the charging timer"),
    "plug-in-habit": (hour_label, " is when it is mostly plugged in"),
    "charge-limit": (number_label, " % ends a charge"),
    "ac-only": (lambda v: number_label(v, 1), " kW at most, never from a fast charger"),
    "idle-days": (number_label, " days without a trip"),
    "busiest-day": (number_label, " km on the longest day"),
    "phantom-drain": (lambda v: number_label(v, 1), " % a day lost while parked"),
    "implied-range": (number_label, " km from a full charge"),
    "door-rhythm": (number_label, " times a door was opened"),
    "sample-count": (number_label, " seconds recorded"),
    "empty-columns": (number_label, " signals always empty"),
    "duplicate-rows": (number_label, " rows delivered again"),
    "beijing-time": (hour_label, " local time begins the day of the file"),
    "pack-spread": (number_label, " °C between warmest and coolest sensor"),
    "tyre-weather": (lambda v: number_label(v, 2), " correlation of tyres and temperature"),
    "no-gps": (lambda v: F.lit("No"), " place is recorded"),
    "vin-repetition": (number_label, " rows name the vehicle"),
    "routine-exposure": (number_label, " door events show a routine"),
    "second-resolution": (number_label, " second between rows"),
}


def worded(ranked_facts: DataFrame) -> DataFrame:
    """ranked_facts with a text for each fact, in this library's own words."""
    text = F.lit(None).cast("string")
    for name, (shown, after) in _SHOWN.items():
        value = shown(F.col("value").cast("long") if shown is hour_label else F.col("value"))
        text = F.when(F.col("id") == name, F.concat(value, F.lit(after))).otherwise(text)
    return ranked_facts.withColumn("text", text)


def fact_trips(trips: DataFrame, tz: str, key: str = "vin") -> DataFrame:
    """(key, id, trip_start_t, moment): the trip that a fact points to: the longest one, the first on ties, and the one of the top speed, with the moment that its text names."""
    longest = trips.where("km is not null").groupBy(key).agg(F.max_by("start_t", F.struct(F.col("km"), -F.col("start_t"))).alias("trip_start_t")).withColumn("id", F.lit("longest-trip")).withColumn("_at", F.col("trip_start_t"))
    top = F.max_by(F.struct("start_t", "max_speed_t"), F.struct(F.col("max_speed"), -F.col("max_speed_t"))).alias("m")
    fastest = trips.where("max_speed > 0").groupBy(key).agg(top).select(key, F.col("m.start_t").alias("trip_start_t"), F.lit("top-speed").alias("id"), F.col("m.max_speed_t").alias("_at"))
    return longest.unionByName(fastest).select(key, "id", "trip_start_t", moment_label("_at", tz).alias("moment"))
