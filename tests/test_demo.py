"""The made-up month through the analysis: what it simulates is found again."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilnspan.functions.time import local_hour
from kilnspan.operators import battery, body, charging, decode, facts, spans, trips
from kilnspan.scratch import cut, drop
from kilnspan.sources.demo import EMPTY, demo

TZ = "Europe/Berlin"
NAMES = {"esp_vehspd": "speed", "ldcu_currentgearlev": "gear", "cdcu_totalodometer": "odo", "ldcu_bms_soc_disp": "soc", "bms_battvolt": "volt", "bms_battcurr": "curr", "ldcu_chrgpwr": "chrg", "esp_vehlongaccel": "accel", "esp_vehlateralaccel": "lateral", "ldcu_dstbatdisp_dynamic": "range_km"}


@pytest.fixture(scope="module")
def month(spark):
    df = cut(demo(spark, vehicles=2, seed=7).withColumnsRenamed(NAMES), "demo")
    yield df, cut(trips.detect_trips(df), "trips"), cut(charging.detect_charging(df), "sessions")
    drop(df)


def test_rows(spark, month):
    df, *_ = month
    w = W.partitionBy("vin").orderBy("t")
    x = df.select("vin", "t", "accel", "lateral", "soc", (F.col("t") - F.lag("t").over(w)).alias("dt"), F.abs(F.col("speed") - F.lag("speed").over(w)).alias("dv"), (F.col("odo") - F.lag("odo").over(w)).alias("dk"))
    for r in x.groupBy("vin").agg(F.count("*").alias("n"), F.min("dt").alias("dt"), (F.max("t") - F.min("t")).alias("span"), F.max(F.when(F.col("dt") == 1, F.col("dv"))).alias("dv"), F.min("dk").alias("dk"), F.min("accel").alias("brake"), F.max(F.abs("accel")).alias("a"), F.max(F.abs("lateral")).alias("l"), F.min("soc").alias("low"), F.max("soc").alias("high")).collect():
        assert r.dt >= 1 and 25 * 86400 < r.span <= 31 * 86400 and r.n / r.span < 0.6
        assert r.dv <= 25 and r.dk >= 0 and -1 < r.brake < -0.3 and r.a < 1 and r.l < 1 and 0 <= r.low < r.high <= 100
    signals = [c for c in df.columns if c not in ("vin", "vmodel", "t")]
    assert {r.signal for r in decode.empty_columns(df, signals).collect()} >= set(EMPTY) and "ipuf_acttorq" not in {r.signal for r in decode.empty_columns(df, signals).collect()}


def test_seeds(spark):
    small = lambda **k: demo(spark, days=3, **k)
    key = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("t", "esp_vehspd", "bms_battcurr").cast("decimal(38,0)"))).first()
    assert key(small(seed=7)) == key(small(seed=7)) != key(small(seed=8))
    assert "ipuf_acttorq" in {r.signal for r in decode.empty_columns(small(seed=7, awd=False), ["ipuf_acttorq", "ipur_acttorq"]).collect()} != {"ipur_acttorq"}


def test_the_analysis_finds_the_routine(spark, month):
    df, tr, ch = month
    w = df.groupBy("vin").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"))
    found = {r.vin: r for r in tr.groupBy("vin").agg(F.count("*").alias("n"), F.sum("km").alias("km"), F.avg("kwh_100km").alias("kwh")).collect()}
    hours = tr.groupBy("vin").agg(F.avg(local_hour("start_t", TZ).between(6, 21).cast("int")).alias("day")).collect()
    assert len(found) == 2 and all(r.n > 20 and r.km > 500 and 8 < r.kwh < 40 for r in found.values())
    sessions = charging.charging_summary(ch, TZ).collect()
    assert all(r.sessions > 3 and r.dc > 0 and r.ac > 0 for r in sessions)
    assert all(r.charge_limit == 90 for r in charging.charge_limit(ch, tr).collect())
    assert all(r.hour == 2 and r["count"] > 3 for r in charging.scheduled_hour(ch, TZ).collect())
    doors = body.door_events(df, ["ldcu_driverdoorajarst", "rdcu_psngrdoorajarst"])
    assert doors.count() > 40 and body.door_grid(doors, TZ).agg(F.sum("n")).first()[0] == doors.count()
    drain = battery.drain_summary(battery.phantom_drain(df, ch, tr, w), spans.awake_spans(df), w).collect()
    assert all(r.events > 3 and 0.3 < r.per_day < 6 for r in drain)
    assert all(r.p90 - r.p10 > 10 for r in battery.implied_range(df, "range_km").collect())
    ids = {r.id for r in facts.ranked(df, tr, ch, TZ, schedule=charging.scheduled_hour(ch, TZ)).collect()}
    assert {"distance", "top-speed", "scheduled-charging", "commute-shape", "no-gps"} <= ids and all(r.day > 0.8 for r in hours)
