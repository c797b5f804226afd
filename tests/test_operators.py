"""Hand-built cases with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from kilnspan.functions import labels, numbers
from kilnspan.functions import time as tm
from kilnspan.operators import battery, body, calendar, charging, decode, energy, facts, spans, style, timeline, trips


def frame(spark, t, **columns):
    names = ["vin", "t", *columns]
    rows = [(1, x, *[None if c[i] is None else float(c[i]) for c in columns.values()]) for i, x in enumerate(t)]
    return spark.createDataFrame(rows, ", ".join(["vin int", "t long", *(f"{n} double" for n in names[2:])]))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_awake_spans_and_gaps(spark):
    df = frame(spark, [100, 101, 102, 500, 501, 4000])
    s = spans.awake_spans(df)
    assert rows(s, "start_t", "end_t", "rows") == [(100, 102, 3), (500, 501, 2), (4000, 4000, 1)]
    assert rows(spans.sleep_gaps(spans.awake_spans(frame(spark, [0, 1, 5000, 5001]))), "seconds") == [(4999,)]
    assert rows(spans.awake_spans(frame(spark, [])), "start_t") == []


def test_energy(spark):
    n = 3601
    e = energy.integrate_energy(frame(spark, range(n), volt=[400] * n, curr=[100] * n), ["vin"]).first()
    assert (e.discharged, e.charged, e.peak_kw) == (pytest.approx(40), 0, 40)
    gap = energy.integrate_energy(frame(spark, [0, 3600], volt=[400, 400], curr=[100, 100]), ["vin"]).first()
    assert (gap.discharged, gap.charged) == (0, 0)
    assert energy.integrate_signal(frame(spark, range(n), x=[11] * n), "x", ["vin"]).first().kwh == pytest.approx(11)


def drive(spark, parts, odo=None):
    gear = [g for g, _, n in parts for _ in range(n)]
    speed = [v for _, v, n in parts for _ in range(n)]
    n = len(gear)
    return frame(spark, range(1000, 1000 + n), gear=gear, speed=speed, odo=odo or [i // 60 for i in range(n)], soc=[80] * n, volt=[400] * n, curr=[10] * n)


def test_trips(spark):
    odo = [1000 + min(10, max(0, i - 100) // 60) for i in range(1000)]
    t = trips.detect_trips(drive(spark, [(4, 0, 100), (1, 60, 600), (4, 0, 300)], odo)).collect()
    assert len(t) == 1 and t[0].km == 9 and t[0].max_speed == 60 and t[0].moving_s > 500
    assert trips.detect_trips(drive(spark, [(3, 2, 50)], [5] * 50)).collect() == []
    assert len(trips.detect_trips(drive(spark, [(1, 50, 300), (1, 0, 30), (1, 50, 300), (4, 0, 70)])).collect()) == 1


def slow_trips(t, drv, stop):
    out, start, last = [], None, None
    for i, (x, d) in enumerate(zip(t, drv, strict=True)):
        if start is not None and i and x - t[i - 1] > 60:
            out.append((start, last))
            start = None
        if d:
            start = x if start is None else start
            last = x
        elif start is not None and x - last >= stop:
            out.append((start, last))
            start = None
    return [*out, (start, last)] if start is not None else out


def test_trip_candidates_equal_the_state_machine(spark):
    r = random.Random(1)
    data, want = [], []
    for vin in range(120):
        t, x, d = [], 0, r.random() < 0.5
        drv = []
        for _ in range(r.randrange(1, 60)):
            x += r.choice([1, 5, 20, 30, 59, 60, 61])
            d = d if r.random() < 0.7 else not d
            t.append(x)
            drv.append(d)
            data.append((vin, x, 1 if d else 4, 0.0))
        want += [(vin, a, b) for a, b in slow_trips(t, drv, 120)]
    df = spark.createDataFrame(data, "vin int, t long, gear int, speed double")
    assert rows(trips.with_trips(df).select("vin", "start_t", "end_t").distinct(), "vin", "start_t", "end_t") == sorted(want)


def charge(spark, spans_, kw, soc):
    t = [x for a, n in spans_ for x in range(a, a + n)]
    n = len(t)
    return frame(spark, t, chrg=[kw] * n, soc=[soc[0] + (soc[1] - soc[0]) * i / max(1, n - 1) for i in range(n)], odo=[10] * n, volt=[400] * n, curr=[-25] * n)


def test_charging(spark):
    s = charging.detect_charging(charge(spark, [(0, 3601)], 11, (20, 60))).collect()
    assert len(s) == 1 and s[0].kwh == pytest.approx(11) and not s[0].is_dc and s[0].soc_gain == 40
    assert charging.detect_charging(charge(spark, [(0, 1200)], 150, (20, 60))).first().is_dc
    assert charging.detect_charging(charge(spark, [(0, 1800), (2000, 1800)], 11, (20, 60))).count() == 1
    assert charging.detect_charging(charge(spark, [(0, 60)], 10, (90, 90))).count() == 0


def test_charge_limit_and_hour(spark):
    at = lambda ends: spark.createDataFrame([(1, k * 86400, k * 86400 + 100, 20.0, float(e)) for k, e in enumerate(ends)], "vin int, start_t long, end_t long, soc_gain double, soc_end double")
    none = spark.createDataFrame([], "vin int, start_t long, end_t long")
    assert rows(charging.charge_limit(at([90] * 9 + [100] * 4), none), "charge_limit") == [(90,)]
    assert charging.charge_limit(at([100] * 5), none).first().charge_limit is None
    first = 1785715200  # 2026-08-03 00:00 UTC, 02:00 in Berlin
    s = spark.createDataFrame([(1, first + k * 86400) for k in range(6)], "vin int, start_t long")
    assert tuple(charging.scheduled_hour(s, "Europe/Berlin").select("hour", "count").first()) == (2, 6)
    drift = spark.createDataFrame([(1, first + k * 90000) for k in range(8)], "vin int, start_t long")
    assert charging.scheduled_hour(drift, "Europe/Berlin").first().hour is None


def test_local_time(spark):
    d = spark.createDataFrame([(1785715200,)], "t long")
    assert d.select(tm.local_hour("t", "Europe/Berlin"), tm.local_hour("t", "UTC"), tm.weekday("t", "UTC")).first()[:] == (2, 0, 1)
    day = spark.sql("select date'2026-10-25' as day")
    assert day.select(tm.day_start("day", "Europe/Berlin")).first()[0] == 1792879200


def test_top_events(spark):
    df = frame(spark, range(1000, 1006), v=[10, 90, 80, 20, 70, 30])
    assert rows(style.top_events(df, "v", 2, 1, 3), "rank", "t", "value") == [(1, 1001, 90.0), (2, 1004, 70.0)]
    assert rows(style.top_events(frame(spark, range(4), v=[0.1, -0.9, -0.2, 0.4]), "v", 1, -1), "value") == [(-0.9,)]
    assert style.top_events(frame(spark, range(3), v=[None] * 3), "v").collect() == []


def test_merge_keeps_the_newest_value(spark):
    src = lambda i, t, v: [(1, i, x, y) for x, y in zip(t, v, strict=True)]
    df = spark.createDataFrame(src("a", [100, 101, 102], [10, 10, 10]) + src("b", [101, 102, 103], [None, 20, 20]), "vin int, export_id string, t long, v int")
    assert rows(timeline.merge_newest(df, ["v"]), "t", "v") == [(100, 10), (101, 10), (102, 20), (103, 20)]
    with pytest.raises(ValueError):
        timeline.one_vehicle(spark.createDataFrame([("a",), ("b",)], "vin string"))


def test_windows_doors_medians(spark):
    w = spark.createDataFrame([(1, 0, 10, "a"), (1, 10, 20, "b"), (1, 12, 15, "c"), (1, 30, 40, "d")], "vin int, start_t long, end_t long, export_id string")
    assert rows(spans.coalesce_windows(w), "start_t", "end_t", "export_id") == [(0, 20, "b"), (30, 40, "d")]
    d = frame(spark, range(7), door=[1, None, 0, 0, 1, 1, None])
    assert sorted(body.door_events(d, ["door"]).select("t", "open_s").collect()) == [(0, 2), (4, None)]
    v = frame(spark, range(5), x=[4, 1, 3, 2, None])
    half = lambda df: rows(numbers.nth_values(df, ["vin"], [("x", 0.5, "mid"), ("x", 0.0, "low"), ("x", 1.0, "top")]), "mid", "low", "top")
    assert half(v) == [(3, 1, 4)] and half(v.where("x is null")) == [(None, None, None)]
    assert frame(spark, range(4), x=[1, 2, 3, 4], y=[5, 5, 5, 5]).agg(numbers.correlation("x", "y")).first()[0] is None


def test_stride_sample_equals_the_loop(spark):
    r = random.Random(2)
    t = sorted(r.sample(range(40000), 600))
    picked, nxt = [], None
    for x in t:
        if nxt is None or x >= nxt:
            picked.append(x)
            nxt = x + 600
    assert [x for (x,) in rows(battery.stride_sample(frame(spark, t), 600, ["vin"]), "t")] == picked


def test_decode(spark):
    f = spark.createDataFrame([(255.0, 2496.7, 255.75, -2.5), (85.0, -12.3, 701.25, 2.5)], "s double, a double, p double, h double")
    got = f.select(decode.decode(F.col("s"), "u8", 1.0, (255.0,)), decode.decode(F.col("a"), "i16", 0.1, (2496.7,)), decode.decode(F.col("p"), "u16", 0.25, (0.0, 701.25)), numbers.half_up(F.col("h"))).collect()
    assert got[0][0] is None and got[0][1] is None and got[0][2] == 255.75 and got[0][3] == -2
    assert got[1][0] == 85 and got[1][1] == pytest.approx(-12.3) and got[1][2] is None and got[1][3] == 3


def test_every_moment_gets_its_trip(spark):
    df = frame(spark, range(12), x=[0] * 12).unionByName(frame(spark, [5], x=[0]).withColumn("vin", F.lit(2)))
    tr = spark.createDataFrame([(1, 2, 4), (1, 5, 5), (1, 8, 9), (3, 0, 99)], "vin int, start_t long, end_t long")
    held = {2: 2, 3: 2, 4: 2, 5: 5, 8: 8, 9: 8}
    assert sorted(map(tuple, style.in_trip(df.select("vin", "t"), tr).collect())) == [(1, t, held.get(t)) for t in range(12)] + [(2, 5, None)]


def test_as_of_takes_the_last_row_at_or_before(spark):
    df = frame(spark, [10, 20, 30], x=[1, None, 3])
    asked = spark.createDataFrame([(1, t, t) for t in (9, 10, 25, 30, 99)] + [(2, 50, 50)], "vin int, t long, own int")
    got = rows(timeline.as_of(asked, df, ["x"]).na.fill(-1), "own", "found_t", "x")
    assert got == [(9, -1, -1), (10, 10, 1), (25, 20, -1), (30, 30, 3), (50, -1, -1), (99, 30, 3)]


def test_drain_leaves_out_the_charged_stops_of_every_vehicle(spark):
    two = lambda rows, names: spark.createDataFrame([(v, *r) for v in (1, 2) for r in rows], f"vin int, {names}")
    df = two([(100, 80.0), (30000, 76.0), (60000, 70.0)], "t long, soc double")
    tr = two([(0, 100), (30000, 30000), (60000, 60001)], "start_t long, end_t long")
    ch, w = two([(40000, 41000)], "start_t long, end_t long"), two([(0, 90000)], "start_t long, end_t long")
    events = battery.phantom_drain(df, ch, tr, w)
    assert rows(events, "vin", "from_t", "soc_lost") == [(1, 100, 4.0), (2, 100, 4.0)]
    s = battery.drain_summary(events, spans.awake_spans(df), w).collect()
    assert sorted((x.vin, x.events, x.soc_lost, x.longest_sleep_h) for x in s) == [(v, 1, 4.0, 30000 / 3600) for v in (1, 2)]
    assert s[0].per_day == pytest.approx(4 / (29900 / 3600) * 24)


@pytest.mark.parametrize("near", [600, 601])
def test_drain_looks_at_most_so_many_rows_away(spark, near):
    far = 30000
    t = [*range(near + 1), *range(far, far + near + 1)]
    soc = [80, *[None] * near, *[None] * near, 76]
    tr = spark.createDataFrame([(1, 0, near), (1, far, far + 10)], "vin int, start_t long, end_t long")
    none, w = spark.createDataFrame([], "vin int, start_t long, end_t long"), spark.createDataFrame([(1, 0, 99999)], "vin int, start_t long, end_t long")
    assert rows(battery.phantom_drain(frame(spark, t, soc=soc), none, tr, w), "soc_lost") == ([(4.0,)] if near == 600 else [])


def test_a_day_is_covered_by_any_touch(spark):
    at = lambda text: spark.sql(f"select unix_timestamp(timestamp'{text} UTC') as t").first().t
    w = spark.createDataFrame([(1, at("2026-10-24 22:00:00"), at("2026-10-25 22:59:59")), (2, at("2026-03-28 22:59:59"), at("2026-03-28 23:00:00"))], "vin int, start_t long, end_t long")
    got = sorted((x.vin, str(x.day)) for x in calendar.covered_days(w, "Europe/Berlin").collect())
    assert got == [(1, "2026-10-25"), (2, "2026-03-28")]


def test_labels(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    n = lambda v: F.lit(v).cast("double")
    assert [one(labels.duration_label(n(s))) for s in (0, 59, 3600, 3900, 36060)] == ["—", "1 min", "1 h 00 min", "1 h 05 min", "10 h 01 min"]
    assert [one(labels.clock_label(n(s))) for s in (-1, 0, 59, 61, 3661)] == ["—", "0 s", "59 s", "1 min", "1 h 01 min"]
    assert [one(labels.clock_label(n(s), True)) for s in (61, 3661)] == ["1m", "1h 01m"]
    assert [one(labels.long_label(n(s))) for s in (None, 100, 86400, 180000)] == ["—", "1 min", "1 d 0 h", "2 d 2 h"]
    assert [one(labels.bytes_label(n(b))) for b in (0, 1, 1023, 1024, 10240, 5 << 20, 3 << 40)] == ["—", "1 B", "1,023 B", "1.0 kB", "10 kB", "5.0 MB", "3,072 GB"]
    assert [one(labels.money_label(n(v))) for v in (float("nan"), 5, 99.994, 1234.5, -2)] == ["—", "£5.00", "£99.99", "£1,235", "-£2.00"]
    assert [one(labels.percent_label(n(v), 1)) for v in (0.1234, None)] == ["12.3%", "—"]
    assert one(labels.measure_label(n(12345.678), "km", 1)) == "12,345.7 km" and one(labels.number_label(n(float("inf")))) == "—"
    at = spark.createDataFrame([(1785715200,)], "t long")
    assert at.select(labels.full_moment_label("t", "Europe/Berlin")).first()[0] == "Monday 3 August at 02:00"


def test_every_rule_of_the_facts_fires(spark):
    start = 1785715200 + 5 * 3600  # 07:00 in Berlin
    tr = spark.createDataFrame([(1, start + k * 86400 + 43200 * (k % 2), start + k * 86400 + 43200 * (k % 2) + 600, 9.0 + k, 500, 80 + k, start + k * 86400 + 60) for k in range(14)], "vin int, start_t long, end_t long, km double, moving_s long, max_speed int, max_speed_t long")
    ch = spark.createDataFrame([(1, start + k * 90000, 11.0, False, 7.0) for k in range(6)], "vin int, start_t long, max_kw double, is_dc boolean, kwh double")
    t = lambda text, schema: spark.createDataFrame(text, "vin int, " + schema)
    more = {
        "brakes": t([(1, -0.7)], "value double"), "limit": t([(1, 80)], "charge_limit int"), "days": t([(1, True, 0.0)], "covered boolean, km double"),
        "drain": t([(1, 2.0, 24.0)] * 3, "soc_lost double, hours double"), "full_range": t([(1, 400.0)], "p50 double"), "doors": t([(1, "a")], "door string"),
        "empty": t([(1, "x")], "signal string"), "report": t([(1, 9, 2)], "rows long, duplicates long"), "thermal": t([(1, 6.0)], "spread double"), "tyres": t([(1, 0.8)], "r double"),
    }
    df = frame(spark, [start], x=[1])
    timed = facts.worded(facts.ranked(df, tr, ch, "Europe/Berlin", schedule=t([(1, 2)], "hour int"), **more))
    free = facts.worded(facts.ranked(df, tr, ch, "Europe/Berlin", schedule=t([(1, None)], "hour int"), **more))
    got = {x.id: x for x in timed.collect()} | {x.id: x for x in free.collect()}
    assert set(got) == set(facts._SHOWN) and all(x.text for x in got.values())
    assert got["commute-shape"].value == 14 and got["phantom-drain"].text == "2.0 % a day lost while parked" and got["scheduled-charging"].text.startswith("02:00")
    assert got["time-driving"].text == "1 h 57 min at the wheel" and got["distance"].text == "217 km driven"
    links = {x.id: x for x in facts.fact_trips(tr, "Europe/Berlin").collect()}
    assert links["longest-trip"].trip_start_t == links["top-speed"].trip_start_t == start + 13 * 86400 + 43200


def test_slices_skip_signals_without_readings(spark):
    df = frame(spark, range(10), a=range(10), b=[None] * 10, c=[None] * 9 + [1])
    spans_ = spark.createDataFrame([(1, 2, 4), (1, 7, 7)], "vin int, start_t long, end_t long")
    got = rows(trips.slices(df, spans_, {n: F.col(n) for n in "abc"}), "start_t", "signal", "t", "value")
    assert got == sorted([(s, n, t, float(t) if n == "a" else None) for s, e in ((2, 4), (7, 7)) for n in "ac" for t in range(s, e + 1)])
