"""A query per operator over the views, with independent SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels, numbers
from ..functions import time as tm
from ..operators import battery, body, calendar, charging, decimate, decode, energy, facts, spans, style, timeline, trips
from ..scratch import cut, shared_dir
from ..sources.exports import ingest
from ..sources.library import Library
from .views import HAB, TEL, as_export, ev, hab, tel

TZ = "Europe/Berlin"
KINDS = {"l": "bigint", "d": "double", "s": "string", "b": "boolean"}
LOCAL = lambda t: f"((TIMESTAMP '1970-01-01' + to_seconds(CAST({t} AS BIGINT))) AT TIME ZONE 'UTC' AT TIME ZONE '{TZ}')"


@dataclass(frozen=True)
class Query:
    """columns: "name:kind ..."; both sides are cast to these kinds and doubles rounded, so that sums in another order compare equal."""

    columns: str
    plan: Callable[[SparkSession, str], DataFrame]
    sql: str

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = []
        for c, k in self._columns():
            x = F.col(c).cast(KINDS[k])
            out.append((F.round(x, 6) if k == "d" else x).alias(c))
        return self.plan(spark, sf_dir).select(*out)

    def oracle(self) -> str:
        types = KINDS | {"s": "VARCHAR"}
        cast = ", ".join((f'round(CAST("{c}" AS DOUBLE), 6) AS "{c}"' if k == "d" else f'CAST("{c}" AS {types[k]}) AS "{c}"') for c, k in self._columns())
        ctes, _, final = self.sql.rpartition(";;")
        return f"WITH {ctes.strip()} SELECT {cast} FROM ({final})" if ctes.strip() else f"SELECT {cast} FROM ({final})"

    def _columns(self) -> list[list[str]]:
        return [x.split(":") for x in self.columns.split()]


_TEL = "tel AS (" + TEL.format(lineitem="lineitem") + ")"
_EV = "ev AS (SELECT user_id AS vin, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type AS kind, value FROM events)"
_AW = _TEL + """, gp AS (SELECT *, lag(t) OVER (PARTITION BY vin ORDER BY t) AS pt FROM tel),
aw AS (SELECT *, sum(CASE WHEN t - pt > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY vin ORDER BY t) AS aw FROM gp),
sp AS (SELECT vin, aw, min(t) AS start_t, max(t) AS end_t, count(*) AS rows FROM aw GROUP BY vin, aw)"""
_STEP = """(SELECT *, lag(v) OVER (PARTITION BY vin, s ORDER BY t) AS pv, t - lag(t) OVER (PARTITION BY vin, s ORDER BY t) AS dt FROM {})"""
_TRIPS = _AW + """, dr AS (SELECT *, coalesce(gear IN (1,2,3), false) OR coalesce(speed > 0, false) AS drv FROM aw),
k AS (SELECT *, lag(t) OVER (PARTITION BY vin, aw ORDER BY t) AS la, max(CASE WHEN drv THEN t END) OVER (PARTITION BY vin, aw ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pd FROM dr),
g AS (SELECT *, sum(CASE WHEN drv AND (pd IS NULL OR la - pd >= 120) THEN 1 ELSE 0 END) OVER (PARTITION BY vin, aw ORDER BY t) AS tr FROM k),
cand AS (SELECT vin, aw, tr, min(t) AS start_t, max(CASE WHEN drv THEN t END) AS end_t FROM g WHERE tr > 0 GROUP BY vin, aw, tr),
tr0 AS (SELECT c.start_t, c.end_t, c.start_t AS s, x.*, volt * curr / 1000.0 AS v FROM cand c JOIN tel x ON x.vin = c.vin AND x.t BETWEEN c.start_t AND c.end_t),
tr1 AS """ + _STEP.format("tr0") + """, tr2 AS (SELECT *, CASE WHEN dt > 0 AND dt <= 10 THEN (v + pv) / 2 * dt / 3600 END AS kwh FROM tr1),
trips AS (SELECT vin, start_t, end_t, end_t - start_t AS duration_s, greatest(0, arg_max(odo, t) - arg_min(odo, t)) AS km, coalesce(sum(CASE WHEN speed > 0 AND dt > 0 AND dt <= 10 THEN dt END), 0) AS moving_s,
  greatest(0, coalesce(max(speed), 0)) AS max_speed, arg_min(soc, t) AS soc_start, arg_max(soc, t) AS soc_end, coalesce(sum(CASE WHEN kwh >= 0 THEN kwh END), 0) AS discharged, coalesce(sum(CASE WHEN kwh < 0 THEN -kwh END), 0) AS charged,
  greatest(0, max(v)) AS peak_kw, greatest(0, -min(v)) AS peak_regen_kw
  FROM tr2 GROUP BY vin, start_t, end_t HAVING end_t - start_t >= 30 AND arg_max(odo, t) - arg_min(odo, t) >= 0.2)"""
_CHARGE = """, ac AS (SELECT *, t - lag(t) OVER (PARTITION BY vin ORDER BY t) > 14400 OR coalesce(odo > lag(odo) OVER (PARTITION BY vin ORDER BY t), false) AS nw FROM tel WHERE chrg > 0.05),
rn AS (SELECT vin, min(t) AS start_t, max(t) AS end_t FROM (SELECT *, sum(CASE WHEN nw THEN 1 ELSE 0 END) OVER (PARTITION BY vin ORDER BY t) AS r FROM ac) GROUP BY vin, r),
c0 AS (SELECT r.start_t, r.end_t, r.start_t AS s, x.*, chrg AS v FROM rn r JOIN tel x ON x.vin = r.vin AND x.t BETWEEN r.start_t AND r.end_t),
c1 AS """ + _STEP.format("c0") + """, c2 AS (SELECT vin, start_t, end_t, end_t - start_t AS duration_s, max(chrg) AS max_kw, arg_min(soc, t) AS soc_start, arg_max(soc, t) AS soc_end, coalesce(sum(CASE WHEN dt > 0 AND dt <= 10 THEN (v + pv) / 2.0 * dt / 3600 END), 0) AS kwh FROM c1 GROUP BY vin, start_t, end_t),
sessions AS (SELECT *, soc_end - soc_start AS soc_gain, max_kw > 22 AS is_dc, CASE WHEN duration_s > 0 THEN kwh * 3600 / duration_s END AS avg_kw FROM c2 WHERE duration_s >= 300 OR coalesce(soc_end - soc_start >= 1, false))"""
_BOTH = _TRIPS + _CHARGE
#: The same tables over hab: what is written of tel holds of it.
_ON_HAB = lambda sql: sql.replace(_TEL, "tel0 AS (" + TEL.format(lineitem="lineitem") + "), tel AS (" + HAB.format(tel="tel0") + ")")
_DRAIN = """, gp2 AS (SELECT vin, lag(end_t) OVER (PARTITION BY vin ORDER BY start_t) AS from_t, start_t AS to_t FROM trips), gq AS (SELECT * FROM gp2 g WHERE to_t - from_t >= 21600 AND NOT EXISTS (SELECT 1 FROM sessions x WHERE x.vin = g.vin AND x.end_t >= g.from_t AND x.start_t <= g.to_t)),
dz AS (SELECT g.*, a.soc AS soc_start, b.soc AS soc_end, (to_t - from_t) / 3600.0 AS hours FROM gq g JOIN tel a ON a.vin = g.vin AND a.t = g.from_t JOIN tel b ON b.vin = g.vin AND b.t = g.to_t)"""
_WINDOWS = "windows AS (SELECT vin, min(t) AS start_t, max(t) AS end_t FROM tel GROUP BY vin)"


def _trips(s, d):
    return trips.detect_trips(tel(s, d))


def _sessions(s, d):
    return charging.detect_charging(tel(s, d))


def _span(x):
    return x.groupBy("vin").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"))


def _windows(s, d):
    return _span(tel(s, d))


def _analysed(x):
    """(rows, trips, sessions, windows), each written once for all that reads it."""
    x = cut(x, "rows")
    return x, cut(trips.detect_trips(x), "trips"), cut(charging.detect_charging(x), "sessions"), _span(x)


def _exports(s, d):
    """tel as three overlapping recordings with gaps in their cells."""
    x = tel(s, d)
    n = F.col("t") % 86400
    a = x.where(n < 50000).withColumn("export_id", F.lit("a"))
    b = x.where(n >= 30000).withColumn("export_id", F.lit("b")).withColumn("speed", F.when(F.col("t") % 3 != 0, F.col("speed")))
    c = x.where(n.between(40000, 60000)).withColumn("export_id", F.lit("c")).withColumn("soc", F.when(F.col("t") % 5 != 0, F.col("soc") - 1))
    return a.unionByName(b).unionByName(c)


_EXPORTS = _TEL + """, ex AS (SELECT vin, t, speed, soc, odo, 'a' AS export_id FROM tel WHERE t % 86400 < 50000 UNION ALL
SELECT vin, t, CASE WHEN t % 3 <> 0 THEN speed END, soc, odo, 'b' FROM tel WHERE t % 86400 >= 30000 UNION ALL
SELECT vin, t, speed, CASE WHEN t % 5 <> 0 THEN soc - 1 END, odo, 'c' FROM tel WHERE t % 86400 BETWEEN 40000 AND 60000)"""


def _streams(s, d):
    x = tel(s, d)
    return [x.where("t % 7 <> 0").select("vin", "t", "speed", "gear"), x.where("t % 5 <> 0").select("vin", "t", "volt", "curr"), x.where("t % 2 = 0").select("vin", "t", "door")]


def _files(s, d):
    """ev with the rows of even seconds once more in a second part, changed."""
    e = ev(s, d).withColumn("part", F.lit(0))
    return e.unionByName(e.where("t % 2 = 0").withColumn("part", F.lit(1)).withColumn("value", F.col("value") + 1)).withColumn("row_in_part", F.col("t"))


_FILES = _EV + ", f AS (SELECT *, 0 AS part FROM ev UNION ALL SELECT vin, t, kind, value + 1, 1 FROM ev WHERE t % 2 = 0)"


def _ev_windows(s, d):
    """Each user's events as overlapping intervals of up to a day."""
    return ev(s, d).select("vin", F.col("t").alias("start_t"), (F.col("t") + F.col("t") % 86400).alias("end_t"), F.concat(F.lit("e"), F.col("t").cast("string")).alias("export_id"))


_DOORS = _TEL + """, e AS (SELECT *, lag(door, 1, 0) OVER (PARTITION BY vin ORDER BY t) AS p FROM tel WHERE door IS NOT NULL), ed AS (SELECT vin, t, door, lead(t) OVER (PARTITION BY vin ORDER BY t) - t AS open_s FROM e WHERE (door = 1) <> (p = 1)),
doors AS (SELECT vin, t, open_s FROM ed WHERE door = 1)"""


def _doors(s, d):
    return body.door_events(tel(s, d), ["door"])


def _tyres(x):
    x = x.withColumn("fl", F.col("tyre_raw") * 0.25).withColumn("fr", F.when(F.col("t") % 3 > 0, F.col("tyre_raw") * 0.25 + F.col("t") % 7)).withColumn("temp", F.col("soc") / 3.0)
    return body.tyre_days(x, ["fl", "fr"], "temp", TZ)


_LIMITS = """, lst AS (SELECT * FROM sessions x WHERE soc_gain >= 1 AND NOT EXISTS (SELECT 1 FROM trips y WHERE y.vin = x.vin AND y.start_t >= x.end_t AND y.start_t < x.end_t + 1800)), llv AS (SELECT vin, floor(soc_end + 0.5) AS l, count(*) AS n FROM lst GROUP BY ALL),
lb AS (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY n DESC, l DESC) AS r FROM llv)"""


def _stride(rows: str, stride: int, part: str) -> str:
    """SQL of a greedy stride over rows (vin, t, ...): a recursive walk from pick to pick."""
    return f"""walk AS (SELECT {part}, min(t) AS t FROM {rows} GROUP BY {part} UNION ALL
SELECT {", ".join(f"w.{p.strip()}" for p in part.split(","))}, (SELECT min(r.t) FROM {rows} r WHERE {" AND ".join(f"r.{p.strip()} = w.{p.strip()}" for p in part.split(","))} AND r.t >= w.t + {stride}) AS t FROM walk w WHERE w.t IS NOT NULL),
picked AS (SELECT r.* FROM {rows} r JOIN walk w USING ({part}, t))"""


_UPPER = lambda c: f"list_sort(list({c}) FILTER ({c} IS NOT NULL))[CAST(floor(count({c}) / 2) AS BIGINT) + 1]"
_TYRES = "RECURSIVE " + _TEL + f""", ty AS (SELECT vin, t, CAST({LOCAL('t')} AS DATE) AS day, tyre_raw * 0.25 AS fl, CASE WHEN t % 3 > 0 THEN tyre_raw * 0.25 + t % 7 END AS fr, soc / 3.0 AS temp FROM tel), """ + _stride("ty", 300, "vin, day") + f""",
days AS (SELECT vin, day, {_UPPER('fl')} AS fl, {_UPPER('fr')} AS fr, {_UPPER('temp')} AS temp FROM picked GROUP BY vin, day)"""

_ALL_TYRES = _TYRES.removeprefix("RECURSIVE " + _TEL).replace("walk", "tywalk").replace("picked", "typicked").replace("days AS", "tydays AS") + """, tym AS (SELECT vin, CASE WHEN fl IS NULL THEN fr WHEN fr IS NULL THEN fl ELSE greatest(fl, fr) END AS y, temp AS x FROM tydays),
tyr AS (SELECT vin, CASE WHEN count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) >= 3 AND stddev_pop(x) * stddev_pop(y) > 0 THEN corr(y, x) END AS r FROM tym GROUP BY vin)"""

# every pick is the best row that all picks before leave: a recursion over picks with the list of those times
_TOP = "RECURSIVE " + _TEL + """, pk AS (SELECT vin, 0 AS n, CAST([] AS BIGINT[]) AS ts, CAST(NULL AS BIGINT) AS t, CAST(NULL AS DOUBLE) AS v FROM tel GROUP BY vin UNION ALL
SELECT p.vin, p.n + 1, list_append(p.ts, b.t), b.t, b.v FROM pk p, LATERAL (SELECT x.t, CAST(x.curr AS DOUBLE) AS v FROM tel x WHERE x.vin = p.vin AND x.curr IS NOT NULL AND len(list_filter(p.ts, lambda y: abs(y - x.t) < 60)) = 0 ORDER BY -x.curr DESC, x.t LIMIT 1) b WHERE p.n < 10);; SELECT vin, n AS rank, t, v AS value FROM pk WHERE n > 0"""


def _ranked(t: DataFrame) -> DataFrame:
    """Numbered in order over all tasks: each task's rows get their places from how many rows the tasks before it hold."""
    t = cut(t.orderBy(F.desc_nulls_last("x"), "start_t", "vin").withColumn("_id", F.monotonically_increasing_id()), "ranked")
    task, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    ahead = t.groupBy(task.alias("_task")).count().select("_task", (F.sum("count").over(W.orderBy("_task")) - F.col("count")).alias("_before"))  # a row per task
    return t.withColumn("_task", task).join(F.broadcast(ahead), "_task").withColumn("n", F.col("_before") + row + 1)


def _drain(x, tr, ch, w, swapped=False):
    return battery.phantom_drain(x, *((tr, ch) if swapped else (ch, tr)), w)


def _facts(s, d):
    """All rules, each table from the operator that makes it."""
    x, tr, ch, w = _analysed(hab(s, d))
    tyres = body.tyre_weather(_tyres(x), ["fl", "fr"], "temp")
    return facts.ranked(
        x, tr, ch, TZ, brakes=style.top_events(x, "curr", 1, -1), schedule=charging.scheduled_hour(ch, TZ), limit=charging.charge_limit(ch, tr), days=calendar.day_buckets(x, tr, ch, w, TZ), drain=battery.phantom_drain(x, ch, tr, w),
        full_range=battery.implied_range(x.withColumn("km", F.col("soc") * 4.0 + F.col("t") % 50), "km"), doors=body.door_events(x, ["door"]), empty=decode.empty_columns(x.withColumn("blank", F.when(F.col("vin") != 2, F.col("odo"))), ["speed", "blank"]),
        report=timeline.order_report(x.withColumn("part", F.lit(0)).unionByName(x.where("t % 5 = 0").withColumn("part", F.lit(1))), order=("part", "t")), thermal=battery.pack_thermal(x, "speed", "curr"), tyres=tyres,
    )


def _kept(s, d):
    """tel as recordings of four vehicles, one of them in two, in a library of their own."""
    x = cut(tel(s, d).withColumnRenamed("vin", "n"), "rows")
    named = x.withColumn("vin", F.concat(F.lit("L"), "n")).withColumn("vmodel", F.lit("M"))
    library = Library(s, f"{shared_dir(s)}/library-{uuid.uuid4().hex}")
    for k, part in enumerate(["n = 0", "n = 1", "n = 2 and odo < 1060", "n = 2 and odo >= 1060", "n = 3"]):
        library.keep(f"r{k}", named.where(part).select("vin", "vmodel", "t", F.col("speed").cast("double").alias("esp_vehspd"), F.col("soc").cast("double").alias("other")), is_demo=k == 4)
    return library.vehicles().withColumn("newest", F.col("ids")[0])


def _figures(e):
    return e.select("t", F.when(F.col("t") % 11 > 0, F.col("t") % 100000 - 300).alias("n")).distinct()


def _series_windows(x):
    return x.groupBy("vin").agg((F.min("t") + 1000).alias("from_t"), (F.max("t") - 2000).alias("to_t"))


QUERIES: dict[str, Query] = {
    "decode_sentinels": Query(
        "vin:l t:l speed:d volt:d tyre:d",
        lambda s, d: tel(s, d).select("vin", "t", decode.decode(F.col("speed"), "u8", 1.0, (70.0,)).alias("speed"), decode.decode(F.col("curr") / 10, "i16", 0.1, (2.5,)).alias("volt"), decode.decode(F.col("tyre_raw") * 0.25, "u16", 0.25, (0.0, 258.25)).alias("tyre")),
        _TEL + ";; SELECT vin, t, nullif(speed, 70) AS speed, nullif(floor(curr / 10.0 * (1 / 0.1) + 0.5), 25) * 0.1 AS volt, nullif(tyre_raw, 1033) * 0.25 AS tyre FROM tel",
    ),
    "quantise_roundtrip": Query("raw:l back:d n:l", lambda s, d: ev(s, d).withColumn("raw", decode.quantise(F.col("value"), "i16", 0.25)).withColumn("back", decode.physical(F.col("raw"), 0.25)).groupBy("raw", "back").agg(F.count("*").alias("n")), _EV + ";; SELECT floor(value * 4 + 0.5) AS raw, floor(value * 4 + 0.5) / 4 AS back, count(*) AS n FROM ev GROUP BY ALL"),
    "column_stats": Query("vin:l signal:s n:l low:d high:d", lambda s, d: decode.column_stats(tel(s, d), ["speed", "soc", "curr"]), _TEL + ";; " + " UNION ALL ".join(f"SELECT vin, '{c}' AS signal, count({c}) AS n, min({c}) AS low, max({c}) AS high FROM tel GROUP BY vin" for c in ("speed", "soc", "curr"))),
    "empty_columns": Query("vin:l signal:s", lambda s, d: decode.empty_columns(tel(s, d).withColumn("blank", F.when(F.col("vin") != 2, F.col("odo"))).withColumn("none", F.lit(None).cast("int")), ["speed", "blank", "none"]), _TEL + ";; SELECT DISTINCT vin, 'none' AS signal FROM tel UNION ALL SELECT DISTINCT 2, 'blank' FROM tel WHERE vin = 2"),
    "order_dedupe_first": Query("vin:l t:l value:d part:l", lambda s, d: timeline.order_rows(_files(s, d)), _FILES + ";; SELECT vin, t, arg_min(value, part) AS value, min(part) AS part FROM f GROUP BY vin, t"),
    "out_of_order_flag": Query("vin:l rows:l duplicates:l unsorted:b", lambda s, d: timeline.order_report(_files(s, d)), _FILES + ", o AS (SELECT *, t < lag(t) OVER (PARTITION BY vin ORDER BY part, t) AS down FROM f);; SELECT vin, count(*) AS rows, count(*) - count(DISTINCT t) AS duplicates, coalesce(bool_or(down), false) AS unsorted FROM o GROUP BY vin"),
    "align_full_outer": Query("vin:l t:l speed:l gear:l volt:l curr:l door:l", lambda s, d: timeline.align(_streams(s, d)), _TEL + ", a AS (SELECT * FROM tel WHERE t % 7 <> 0), b AS (SELECT * FROM tel WHERE t % 5 <> 0), c AS (SELECT * FROM tel WHERE t % 2 = 0);; SELECT coalesce(a.vin, b.vin, c.vin) AS vin, coalesce(a.t, b.t, c.t) AS t, a.speed, a.gear, b.volt, b.curr, c.door FROM a FULL JOIN b ON a.vin = b.vin AND a.t = b.t FULL JOIN c ON c.vin = coalesce(a.vin, b.vin) AND c.t = coalesce(a.t, b.t)"),
    "aligned_flag": Query("vin:l aligned:b", lambda s, d: timeline.aligned([tel(s, d).where("vin <> 1 or t % 7 <> 0"), tel(s, d)]), _TEL + ";; SELECT DISTINCT vin, vin <> 1 AS aligned FROM tel"),
    "merge_newest_nonnull": Query(
        "vin:l t:l speed:l soc:l odo:l", lambda s, d: timeline.merge_newest(_exports(s, d), ["speed", "soc", "odo"]),
        _EXPORTS + """, rk AS (SELECT vin, export_id, row_number() OVER (PARTITION BY vin ORDER BY max(t), min(t), export_id) AS r FROM ex GROUP BY vin, export_id), j AS (SELECT ex.*, r FROM ex JOIN rk USING (vin, export_id));;
SELECT vin, t, arg_max(speed, r) FILTER (speed IS NOT NULL) AS speed, arg_max(soc, r) FILTER (soc IS NOT NULL) AS soc, arg_max(odo, r) FILTER (odo IS NOT NULL) AS odo FROM j GROUP BY vin, t""",
    ),
    "coverage_coalesce": Query(
        "vin:l start_t:l end_t:l export_id:s", lambda s, d: spans.coalesce_windows(_ev_windows(s, d)),
        _EV + """, w AS (SELECT vin, t AS start_t, t + t % 86400 AS end_t, 'e' || t AS export_id FROM ev), m AS (SELECT *, max(end_t) OVER (PARTITION BY vin ORDER BY start_t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
i AS (SELECT *, sum(CASE WHEN start_t > reach THEN 1 ELSE 0 END) OVER (PARTITION BY vin ORDER BY start_t) AS isl FROM m), x AS (SELECT *, row_number() OVER (PARTITION BY vin, isl ORDER BY end_t DESC, start_t) AS n FROM i);;
SELECT vin, min(start_t) AS start_t, max(end_t) AS end_t, max(export_id) FILTER (n = 1) AS export_id FROM x GROUP BY vin, isl""",
    ),
    "awake_spans": Query("vin:l start_t:l end_t:l rows:l", lambda s, d: spans.awake_spans(tel(s, d)), _AW + ";; SELECT * FROM sp"),
    "awake_spans_events": Query("vin:l start_t:l end_t:l rows:l", lambda s, d: spans.awake_spans(ev(s, d), 21600), _EV + ", gp AS (SELECT *, lag(t) OVER (PARTITION BY vin ORDER BY t) AS pt FROM ev), aw AS (SELECT *, sum(CASE WHEN t - pt > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY vin ORDER BY t) AS aw FROM gp);; SELECT vin, min(t) AS start_t, max(t) AS end_t, count(*) AS rows FROM aw GROUP BY vin, aw"),
    "sleep_gaps": Query("vin:l from_t:l to_t:l seconds:l", lambda s, d: spans.sleep_gaps(spans.awake_spans(tel(s, d))), _AW + ";; SELECT vin, pt AS from_t, t AS to_t, t - pt AS seconds FROM gp WHERE t - pt > 60"),
    "coverage_seconds": Query("vin:l seconds:l spans:l", lambda s, d: spans.span_seconds(spans.awake_spans(tel(s, d))), _AW + ";; SELECT vin, sum(end_t - start_t) AS seconds, count(*) AS spans FROM sp GROUP BY vin"),
    "power_instant": Query("vin:l t:l kw:d", lambda s, d: tel(s, d).select("vin", "t", energy.power_kw().alias("kw")), _TEL + ";; SELECT vin, t, volt * curr / 1000.0 AS kw FROM tel"),
    "energy_totals": Query(
        "vin:l aw:l discharged:d charged:d peak_kw:d peak_regen_kw:d", lambda s, d: energy.integrate_energy(spans.with_awake(tel(s, d)), ["vin", "aw"]),
        _AW + ", e0 AS (SELECT *, aw AS s, volt * curr / 1000.0 AS v FROM aw), e1 AS " + _STEP.format("e0") + ", e2 AS (SELECT *, CASE WHEN dt > 0 AND dt <= 10 THEN (v + pv) / 2 * dt / 3600 END AS k FROM e1);; SELECT vin, aw, coalesce(sum(k) FILTER (k >= 0), 0) AS discharged, coalesce(-sum(k) FILTER (k < 0), 0) AS charged, greatest(max(v), 0) AS peak_kw, greatest(-min(v), 0) AS peak_regen_kw FROM e2 GROUP BY vin, aw",
    ),
    "signal_kwh": Query("vin:l aw:l kwh:d", lambda s, d: energy.integrate_signal(spans.with_awake(tel(s, d)), "chrg", ["vin", "aw"]), _AW + ", e0 AS (SELECT *, aw AS s, chrg AS v FROM aw), e1 AS " + _STEP.format("e0") + ";; SELECT vin, aw, coalesce(sum(CASE WHEN dt > 0 AND dt <= 10 THEN (v + pv) / 2.0 * dt / 3600 END), 0) AS kwh FROM e1 GROUP BY vin, aw"),
    "trips": Query("vin:l start_t:l end_t:l duration_s:l km:d", _trips, _TRIPS + ";; SELECT * FROM trips"),
    "trip_metrics": Query(
        "vin:l start_t:l moving_s:l max_speed:l soc_start:l soc_end:l discharged:d charged:d peak_kw:d peak_regen_kw:d avg_speed:d regen_share:d kwh_100km:d", _trips,
        _TRIPS + ";; SELECT *, CASE WHEN moving_s > 0 THEN km / moving_s * 3600 END AS avg_speed, CASE WHEN discharged + charged > 0 THEN charged / (discharged + charged) END AS regen_share, CASE WHEN km >= 1 THEN (discharged - charged) / km * 100 END AS kwh_100km FROM trips",
    ),
    "trip_sorted_nulls_last": Query("vin:l start_t:l n:l", lambda s, d: _ranked(trips.detect_trips(tel(s, d)).withColumn("x", F.when(F.col("start_t") % 2 == 0, F.col("km")))), _TRIPS + ";; SELECT vin, start_t, row_number() OVER (ORDER BY CASE WHEN start_t % 2 = 0 THEN km END DESC NULLS LAST, start_t, vin) AS n FROM trips"),
    "charge_sessions": Query("vin:l start_t:l end_t:l max_kw:d soc_start:l soc_end:l soc_gain:l kwh:d avg_kw:d is_dc:b", _sessions, _BOTH + ";; SELECT * FROM sessions"),
    "charge_summary": Query(
        "vin:l sessions:l kwh:d dc:l ac:l max_kw:d plug_in_hour:l plug_in_count:l blips_ignored:l", lambda s, d: charging.charging_summary(charging.detect_charging(hab(s, d)), TZ),
        _ON_HAB(_BOTH) + f", h AS (SELECT vin, hour({LOCAL('start_t')}) AS h, count(*) AS n FROM sessions GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY n DESC, h) AS r FROM h);; SELECT vin, count(*) AS sessions, sum(kwh) AS kwh, sum(CAST(is_dc AS INT)) AS dc, sum(CAST(NOT is_dc AS INT)) AS ac, max(max_kw) AS max_kw, any_value(b.h) AS plug_in_hour, any_value(b.n) AS plug_in_count, 0 AS blips_ignored FROM sessions JOIN b USING (vin) WHERE b.r = 1 GROUP BY vin",
    ),
    "charge_ranges": Query(
        "vin:l start_t:l range_start:d range_end:d", lambda s, d: charging.detect_charging(tel(s, d).withColumn("range_km", F.when(F.col("t") % 4 > 0, F.col("soc") * 4.0 + F.col("t") % 50))),
        _BOTH + ";; SELECT x.vin, start_t, arg_min(soc * 4.0 + t % 50, t) FILTER (t % 4 > 0) AS range_start, arg_max(soc * 4.0 + t % 50, t) FILTER (t % 4 > 0) AS range_end FROM sessions x JOIN (SELECT vin, t, soc FROM tel) y ON y.vin = x.vin AND y.t BETWEEN x.start_t AND x.end_t GROUP BY x.vin, start_t",
    ),
    "charge_limit": Query(
        "vin:l charge_limit:l", lambda s, d: charging.charge_limit(*[_analysed(hab(s, d))[k] for k in (2, 1)]),
        _ON_HAB(_BOTH) + _LIMITS + ";; SELECT vin, CASE WHEN n >= 3 AND l < 99 THEN l END AS charge_limit FROM lb WHERE r = 1",
    ),
    "scheduled_hour": Query(
        "vin:l hour:l count:l sessions:l", lambda s, d: charging.scheduled_hour(ev(s, d).withColumnRenamed("t", "start_t"), TZ),
        _EV + f", h AS (SELECT vin, hour({LOCAL('t')}) AS h, count(*) AS n FROM ev GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY n DESC, h) AS r, sum(n) OVER (PARTITION BY vin) AS tot FROM h);; SELECT vin, CASE WHEN tot >= 4 AND n >= 3 AND n / tot >= 0.3 THEN h END AS hour, n AS count, tot AS sessions FROM b WHERE r = 1",
    ),
    "start_hours": Query("vin:l hour:l n:l", lambda s, d: charging.start_hours(_sessions(s, d), TZ), _BOTH + f", v AS (SELECT DISTINCT vin FROM sessions);; SELECT v.vin, h.h AS hour, count(x.vin) AS n FROM v CROSS JOIN (SELECT unnest(range(24)) AS h) h LEFT JOIN sessions x ON x.vin = v.vin AND hour({LOCAL('x.start_t')}) = h.h GROUP BY ALL"),
    "calendar_days": Query("vin:l day:s", lambda s, d: calendar.calendar_days(tel(s, d), TZ), _TEL + f", b AS (SELECT vin, min(t) AS a, max(t) AS b FROM tel GROUP BY vin), x AS (SELECT vin, unnest(range(a, b + 43201, 43200)) AS u FROM b);; SELECT DISTINCT vin, CAST({LOCAL('u')} AS DATE) AS day FROM x"),
    "day_buckets": Query(
        "vin:l day:s km:d moving_s:l trips:l max_speed:l net_kwh:d charged_kwh:d soc_min:l soc_max:l covered:b",
        lambda s, d: calendar.day_buckets(*(a := _analysed(tel(s, d)))[:3], a[3].withColumn("end_t", F.col("end_t") - 86400), TZ),
        _BOTH + f""", b AS (SELECT vin, min(t) AS a, max(t) AS b FROM tel GROUP BY vin), dy AS (SELECT DISTINCT vin, CAST({LOCAL('u')} AS DATE) AS day FROM (SELECT vin, unnest(range(a, b + 43201, 43200)) AS u FROM b)),
td AS (SELECT vin, CAST({LOCAL('start_t')} AS DATE) AS day, sum(km) AS km, sum(moving_s) AS moving_s, count(*) AS trips, max(max_speed) AS max_speed, sum(discharged - charged) AS net_kwh FROM trips GROUP BY ALL),
sd AS (SELECT vin, CAST({LOCAL('start_t')} AS DATE) AS day, sum(kwh) AS charged_kwh FROM sessions GROUP BY ALL), so AS (SELECT vin, CAST({LOCAL('t')} AS DATE) AS day, min(soc) AS soc_min, max(soc) AS soc_max FROM tel GROUP BY ALL);;
SELECT dy.vin, dy.day, coalesce(km, 0) AS km, coalesce(moving_s, 0) AS moving_s, coalesce(trips, 0) AS trips, coalesce(max_speed, 0) AS max_speed, coalesce(net_kwh, 0) AS net_kwh, coalesce(charged_kwh, 0) AS charged_kwh, soc_min, soc_max,
EXISTS (SELECT 1 FROM b WHERE b.vin = dy.vin AND b.a < epoch(CAST(dy.day AS TIMESTAMP) AT TIME ZONE '{TZ}') + 86400 AND b.b - 86400 > epoch(CAST(dy.day AS TIMESTAMP) AT TIME ZONE '{TZ}')) AS covered FROM dy LEFT JOIN td USING (vin, day) LEFT JOIN sd USING (vin, day) LEFT JOIN so USING (vin, day)""",
    ),
    "punchcard": Query(
        "vin:l weekday:l hour:l seconds:l", lambda s, d: calendar.punchcard(_trips(s, d), TZ),
        _TRIPS + f", st AS (SELECT vin, end_t, unnest(range(start_t, end_t + 1, 300)) AS u FROM trips), c AS (SELECT vin, dayofweek({LOCAL('u')}) AS w, hour({LOCAL('u')}) AS h, sum(least(300, end_t - u + 1)) AS n FROM st GROUP BY ALL), v AS (SELECT DISTINCT vin FROM trips);; SELECT v.vin, i // 24 AS weekday, i % 24 AS hour, coalesce(n, 0) AS seconds FROM v CROSS JOIN (SELECT unnest(range(168)) AS i) LEFT JOIN c ON c.vin = v.vin AND w = i // 24 AND h = i % 24",
    ),
    "local_parts": Query("vin:l t:l day:s hour:l weekday:l off:l", lambda s, d: ev(s, d).select("vin", "t", tm.local_date("t", TZ).alias("day"), tm.local_hour("t", TZ).alias("hour"), tm.weekday("t", TZ).alias("weekday"), tm.zone_offset("t", TZ).alias("off")), _EV + f";; SELECT vin, t, CAST({LOCAL('t')} AS DATE) AS day, hour({LOCAL('t')}) AS hour, dayofweek({LOCAL('t')}) AS weekday, epoch({LOCAL('t')}) - t AS off FROM ev"),
    "speed_histogram": Query("vin:l bin:l left:d n:l", lambda s, d: style.histogram(tel(s, d), "speed", 0, 60, 12, F.col("speed") > 0), _TEL + ", v AS (SELECT DISTINCT vin FROM tel);; SELECT v.vin, b AS bin, b * 5.0 AS left, count(x.vin) AS n FROM v CROSS JOIN (SELECT unnest(range(12)) AS b) LEFT JOIN tel x ON x.vin = v.vin AND x.speed > 0 AND least(11, greatest(0, x.speed // 5)) = b GROUP BY ALL"),
    "value_histogram": Query("vin:l bin:l left:d n:l", lambda s, d: style.histogram(ev(s, d), "value", 20, 100, 20), _EV + ", v AS (SELECT DISTINCT vin FROM ev);; SELECT v.vin, b AS bin, 20 + b * 4.0 AS left, count(x.vin) AS n FROM v CROSS JOIN (SELECT unnest(range(20)) AS b) LEFT JOIN ev x ON x.vin = v.vin AND x.value IS NOT NULL AND least(19, greatest(0, floor((x.value - 20) / 4))) = b GROUP BY ALL"),
    "gg_grid": Query("vin:l row:l col:l n:l", lambda s, d: style.gg_grid(tel(s, d).withColumn("a", F.col("curr") / 64).withColumn("b", (F.col("speed") - 45) / 32), "a", "b", 16, 1.0), _TEL + ", g AS (SELECT vin, floor((curr / 64 + 1) / 2 * 16) AS row, floor(((speed - 45) / 32 + 1) / 2 * 16) AS col FROM tel);; SELECT vin, row, col, count(*) AS n FROM g WHERE row BETWEEN 0 AND 15 AND col BETWEEN 0 AND 15 GROUP BY ALL"),
    "seconds_above": Query("vin:l level:l seconds:l", lambda s, d: style.seconds_above(tel(s, d), levels=(30, 50, 60, 100)), _AW + ", l AS (SELECT unnest([30, 50, 60, 100]) AS level);; SELECT vin, level, sum(coalesce(t - pt, 1)) AS seconds FROM gp, l WHERE speed >= level AND coalesce(t - pt, 1) BETWEEN 1 AND 10 GROUP BY ALL"),
    "speed_peak": Query("vin:l max_speed:l max_speed_t:l", lambda s, d: style.speed_profile(tel(s, d)), _TEL + ", m AS (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY speed DESC NULLS LAST, t) AS r FROM tel);; SELECT vin, speed AS max_speed, t AS max_speed_t FROM m WHERE r = 1"),
    "top_events": Query("vin:l rank:l t:l value:d", lambda s, d: style.top_events(tel(s, d), "curr", 10, -1, 60), _TOP),
    "event_trip_lookup": Query("vin:l t:l trip_start_t:l", lambda s, d: style.in_trip((x := cut(tel(s, d), "rows")).select("vin", "t"), trips.detect_trips(x)), _TRIPS + ";; SELECT x.vin, x.t, y.start_t AS trip_start_t FROM tel x LEFT JOIN trips y ON x.vin = y.vin AND x.t BETWEEN y.start_t AND y.end_t"),
    "as_of": Query(
        "vin:l t:l value:d found_t:l soc:l", lambda s, d: timeline.as_of(ev(s, d).select((F.col("vin") % 4).alias("vin"), "t", "value"), tel(s, d), ["soc"]),
        _TEL + ", " + _EV + ", e4 AS (SELECT vin % 4 AS vin, t, value FROM ev);; SELECT e4.vin, e4.t, value, tel.t AS found_t, soc FROM e4 ASOF LEFT JOIN tel ON e4.vin = tel.vin AND e4.t >= tel.t",
    ),
    "trip_peaks": Query(
        "vin:l start_t:l peak_accel:d peak_brake:d peak_lateral:d", lambda s, d: trips.detect_trips(tel(s, d).withColumn("accel", F.col("curr") / 64.0).withColumn("lateral", F.when(F.col("t") % 3 > 0, (F.col("speed") - 45) / 32.0))),
        _TRIPS + ";; SELECT y.vin, start_t, greatest(0, max(curr / 64.0)) AS peak_accel, greatest(0, max(-curr / 64.0)) AS peak_brake, greatest(0, coalesce(max(abs((speed - 45) / 32.0)) FILTER (t % 3 > 0), 0)) AS peak_lateral FROM trips y JOIN tel x ON x.vin = y.vin AND x.t BETWEEN y.start_t AND y.end_t GROUP BY y.vin, start_t",
    ),
    "trip_slices": Query(
        "vin:l start_t:l signal:s t:l value:d", lambda s, d: trips.slices(x := cut(tel(s, d), "rows"), trips.detect_trips(x), {"speed": F.col("speed"), "power": energy.power_kw(), "soc": F.col("soc"), "brake": F.when(F.col("vin") != 1, F.col("door") * 100)}),
        _TRIPS + ", j AS (SELECT x.*, y.start_t FROM trips y JOIN tel x ON x.vin = y.vin AND x.t BETWEEN y.start_t AND y.end_t);; SELECT vin, start_t, 'speed' AS signal, t, speed AS value FROM j UNION ALL SELECT vin, start_t, 'power', t, volt * curr / 1000.0 FROM j UNION ALL SELECT vin, start_t, 'soc', t, soc FROM j UNION ALL SELECT vin, start_t, 'brake', t, door * 100 FROM j WHERE vin <> 1",
    ),
    "session_slices": Query(
        "vin:l start_t:l signal:s t:l value:d", lambda s, d: trips.slices(x := cut(hab(s, d), "rows"), charging.detect_charging(x), {"charging": F.col("chrg"), "soc": F.col("soc"), "none": F.lit(None)}),
        _ON_HAB(_BOTH) + ", j AS (SELECT x.*, y.start_t FROM sessions y JOIN tel x ON x.vin = y.vin AND x.t BETWEEN y.start_t AND y.end_t);; SELECT vin, start_t, 'charging' AS signal, t, chrg AS value FROM j UNION ALL SELECT vin, start_t, 'soc', t, soc FROM j",
    ),
    "phantom_drain": Query(
        "vin:l from_t:l to_t:l hours:d soc_start:l soc_end:l soc_lost:l per_day:d", lambda s, d: _drain(*_analysed(hab(s, d))),
        _ON_HAB(_BOTH) + _DRAIN + """;;
SELECT *, soc_start - soc_end AS soc_lost, (soc_start - soc_end) / hours * 24 AS per_day FROM dz WHERE soc_start >= soc_end""",
    ),
    "drain_summary": Query(
        "vin:l events:l soc_lost:l hours:d per_day:d longest_sleep_h:d", lambda s, d: battery.drain_summary(_drain(x := cut(hab(s, d), "rows"), charging.detect_charging(x), trips.detect_trips(x), _span(x), True), spans.awake_spans(x), _span(x)),
        _ON_HAB(_BOTH) + _DRAIN + """, ev1 AS (SELECT vin, count(*) AS events, sum(soc_start - soc_end) AS soc_lost, sum(hours) AS hours FROM dz WHERE soc_start >= soc_end GROUP BY vin), sl AS (SELECT vin, max(t - pt) / 3600.0 AS h FROM gp WHERE t - pt > 60 GROUP BY vin);;
SELECT v.vin, coalesce(events, 0) AS events, coalesce(soc_lost, 0) AS soc_lost, coalesce(hours, 0) AS hours, CASE WHEN hours > 0 THEN soc_lost / hours * 24 END AS per_day, coalesce(h, 0) AS longest_sleep_h FROM (SELECT DISTINCT vin FROM tel) v LEFT JOIN ev1 USING (vin) LEFT JOIN sl USING (vin)""",
    ),
    "stride_sample": Query("vin:l t:l", lambda s, d: battery.stride_sample(ev(s, d).select("vin", "t"), 36000, ["vin"]), "RECURSIVE " + _EV + ", " + _stride("ev", 36000, "vin") + ";; SELECT vin, t FROM picked"),
    "implied_range": Query(
        "vin:l samples:l p10:d p50:d p90:d", lambda s, d: battery.implied_range(tel(s, d).withColumn("km", F.col("soc") * 4.0 + F.col("t") % 50), "km"),
        "RECURSIVE " + _TEL + ", ok AS (SELECT vin, t, (soc * 4.0 + t % 50) / soc * 100 AS v FROM tel WHERE soc BETWEEN 30 AND 95 AND soc * 4.0 + t % 50 > 0), " + _stride("ok", 600, "vin") + ";; SELECT vin, count(*) AS samples, " + ", ".join(f"list_sort(list(v))[CAST(least(count(*), floor(count(*) * {p / 100}) + 1) AS BIGINT)] AS p{p}" for p in (10, 50, 90)) + " FROM picked GROUP BY vin",
    ),
    "pack_thermal": Query("vin:l hottest:l coldest:l spread:l spread_t:l", lambda s, d: battery.pack_thermal(tel(s, d).withColumn("cold", F.when(F.col("t") % 3 > 0, F.col("curr"))), "speed", "cold"), _TEL + ", x AS (SELECT vin, t, speed, CASE WHEN t % 3 > 0 THEN curr END AS cold FROM tel), y AS (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY speed - cold DESC NULLS LAST, t) AS r FROM x);; SELECT vin, max(speed) AS hottest, min(cold) AS coldest, max(speed - cold) AS spread, max(t) FILTER (r = 1) AS spread_t FROM y GROUP BY vin"),
    "activity_bands": Query("vin:l start_t:l end_t:l kind:s ord:l", lambda s, d: battery.activity_bands(*_analysed(tel(s, d))[1:3]), _BOTH + ", u AS (SELECT vin, start_t, end_t, 'drive' AS kind FROM trips UNION ALL SELECT vin, start_t, end_t, 'charge' FROM sessions);; SELECT *, row_number() OVER (PARTITION BY vin ORDER BY start_t, kind DESC) AS ord FROM u"),
    "door_events": Query("vin:l t:l open_s:l", _doors, _DOORS + ";; SELECT * FROM doors"),
    "door_grid": Query("vin:l weekday:l hour:l n:l", lambda s, d: body.door_grid(_doors(s, d), TZ), _DOORS + f";; SELECT vin, dayofweek({LOCAL('t')}) AS weekday, hour({LOCAL('t')}) AS hour, count(*) AS n FROM doors GROUP BY ALL"),
    "busiest_hour": Query("vin:l hour:l n:l", lambda s, d: body.busiest_hour(ev(s, d), TZ), _EV + f", h AS (SELECT vin, hour({LOCAL('t')}) AS h, count(*) AS n FROM ev GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY n DESC, h) AS r FROM h);; SELECT vin, h AS hour, n FROM b WHERE r = 1"),
    "quiet_hours": Query("vin:l hour:l", lambda s, d: body.quiet_hours(_doors(s, d), TZ), _DOORS + f", v AS (SELECT DISTINCT vin FROM doors);; SELECT v.vin, h AS hour FROM v CROSS JOIN (SELECT unnest(range(24)) AS h) x WHERE NOT EXISTS (SELECT 1 FROM doors y WHERE y.vin = v.vin AND hour({LOCAL('y.t')}) = h)"),
    "per_door": Query(
        "vin:l door:s n:l", lambda s, d: body.per_door(x := tel(s, d).withColumn("shut", F.when(F.col("vin") != 3, 0)), body.door_events(x, ["door", "shut"]), ["door", "shut"]),
        _DOORS + ";; SELECT v.vin, 'door' AS door, count(y.vin) AS n FROM (SELECT DISTINCT vin FROM tel) v LEFT JOIN doors y ON y.vin = v.vin GROUP BY v.vin UNION ALL SELECT DISTINCT vin, 'shut', 0 FROM tel WHERE vin <> 3",
    ),
    "longest_open": Query("vin:l t:l open_s:l", lambda s, d: body.longest_open(_doors(s, d)), _DOORS + ", r AS (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY open_s DESC, t) AS r FROM doors WHERE open_s IS NOT NULL);; SELECT vin, t, open_s FROM r WHERE r = 1"),
    "gg_readout": Query(
        "vin:l row:l col:l n:l longitudinal:d lateral:d share:d direction:s side:s", lambda s, d: style.gg_readout(style.gg_grid(tel(s, d).withColumn("a", F.col("curr") / 64).withColumn("b", (F.col("speed") - 45) / 32), "a", "b", 16, 1.0), 16, 1.0),
        _TEL + ", g AS (SELECT vin, floor((curr / 64 + 1) / 2 * 16) AS row, floor(((speed - 45) / 32 + 1) / 2 * 16) AS col FROM tel), c AS (SELECT vin, row, col, count(*) AS n FROM g WHERE row BETWEEN 0 AND 15 AND col BETWEEN 0 AND 15 GROUP BY ALL);; SELECT *, (row + 0.5) / 8 - 1 AS longitudinal, (col + 0.5) / 8 - 1 AS lateral, n * 100.0 / sum(n) OVER (PARTITION BY vin) AS share, CASE WHEN row >= 8 THEN 'accelerating' ELSE 'braking' END AS direction, CASE WHEN col >= 8 THEN 'left' ELSE 'right' END AS side FROM c",
    ),
    "best_trips": Query("vin:l place:l start_t:l km:d", lambda s, d: style.best_of(_trips(s, d), "km", 3, tie="start_t"), _TRIPS + ", r AS (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY km DESC NULLS LAST, start_t) AS place FROM trips);; SELECT * FROM r WHERE place <= 3"),
    "ingest_csv": Query(
        "vin:s t:l esp_vehspd:d esp_vehlongaccel:d cdcu_totalodometer:d ldcu_currentgearlev:d bms_battvolt:d bms_battcurr:d ldcu_chrgpwr:d ldcu_bms_soc_disp:d ipuf_acttorq:d ldcu_driverdoorajarst:d ldcu_tpmsprfl:d", lambda s, d: ingest(s, as_export(tel(s, d))).signals,
        _TEL + ", a AS (SELECT * FROM tel WHERE t % 7 <> 0), b AS (SELECT * FROM tel WHERE t % 7 <> 1), c AS (SELECT * FROM tel WHERE t % 7 <> 2);; SELECT coalesce(a.vin, b.vin, c.vin) AS vin, coalesce(a.t, b.t, c.t) AS t, a.speed AS esp_vehspd, a.curr * 0.002768 AS esp_vehlongaccel, a.odo AS cdcu_totalodometer, a.gear AS ldcu_currentgearlev, b.volt AS bms_battvolt, b.curr AS bms_battcurr, b.chrg AS ldcu_chrgpwr, b.soc AS ldcu_bms_soc_disp, CAST(NULL AS DOUBLE) AS ipuf_acttorq, c.door AS ldcu_driverdoorajarst, c.tyre_raw * 0.25 AS ldcu_tpmsprfl FROM a FULL JOIN b ON a.vin = b.vin AND a.t = b.t FULL JOIN c ON c.vin = coalesce(a.vin, b.vin) AND c.t = coalesce(a.t, b.t)",
    ),
    "ingest_report": Query(
        "vin:s stream:s rows:l duplicates:l", lambda s, d: ingest(s, as_export(tel(s, d))).report,
        _TEL + ";; " + " UNION ALL ".join(f"SELECT vin, '{n}' AS stream, count(*) + count(*) FILTER (t % 50 = {k + 10}) AS rows, count(*) FILTER (t % 50 = {k + 10}) AS duplicates FROM tel WHERE t % 7 <> {k} GROUP BY vin" for k, n in enumerate(("operation", "power", "status"))),
    ),
    "library_groups": Query(
        "vin:s recordings:l newest:s is_demo:b bytes_if_merged:l", _kept,
        _TEL + ", k AS (SELECT vin, CASE vin WHEN 0 THEN 'r0' WHEN 1 THEN 'r1' WHEN 2 THEN CASE WHEN odo < 1060 THEN 'r2' ELSE 'r3' END ELSE 'r4' END AS id FROM tel);; SELECT 'L' || vin AS vin, count(DISTINCT id) AS recordings, max(id) AS newest, vin = 3 AS is_demo, count(*) * 9 AS bytes_if_merged FROM k GROUP BY vin",
    ),
    "quiet_stretch": Query(
        "vin:l from_h:l to_h:l hours:l", lambda s, d: body.quiet_stretch(ev(s, d).select("vin", tm.local_hour("t", TZ).alias("hour"))),
        _EV + f""", h AS (SELECT DISTINCT vin, hour({LOCAL('t')}) AS h FROM ev), v AS (SELECT DISTINCT vin FROM h), nx AS (SELECT v.vin, i AS a, coalesce((SELECT min(j) FROM range(i, 48) r(j) WHERE EXISTS (SELECT 1 FROM h WHERE h.vin = v.vin AND h.h = j % 24)), 48) AS b FROM v CROSS JOIN (SELECT unnest(range(24)) AS i)),
m AS (SELECT vin, a, least(24, b - a) AS n FROM nx WHERE b > a), o AS (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY n DESC, a) AS r FROM m);; SELECT vin, a AS from_h, (a + n) % 24 AS to_h, n AS hours FROM o WHERE r = 1""",
    ),
    "tyre_daily_median": Query("vin:l day:s fl:d fr:d temp:d", lambda s, d: _tyres(tel(s, d)), _TYRES + ";; SELECT * FROM days"),
    "tyre_drift": Query("vin:l fl_drift:d fr_drift:d", lambda s, d: body.tyre_drift(_tyres(tel(s, d)), ["fl", "fr"]), _TYRES + ", o AS (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY day) AS a, row_number() OVER (PARTITION BY vin ORDER BY day DESC) AS z FROM days WHERE coalesce(fl, fr) IS NOT NULL);; SELECT x.vin, y.fl - x.fl AS fl_drift, y.fr - x.fr AS fr_drift FROM o x JOIN o y ON x.vin = y.vin AND x.a = 1 AND y.z = 1"),
    "tyre_correlation": Query("vin:l r:d", lambda s, d: body.tyre_weather(_tyres(tel(s, d)), ["fl", "fr"], "temp"), _TYRES + ", m AS (SELECT vin, CASE WHEN fl IS NULL THEN fr WHEN fr IS NULL THEN fl ELSE greatest(fl, fr) END AS y, temp AS x FROM days);; SELECT vin, CASE WHEN count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) >= 3 AND stddev_pop(x) * stddev_pop(y) > 0 THEN corr(y, x) END AS r FROM m GROUP BY vin"),
    "pyramid_level_64": Query("vin:l bucket:l t:l low:d high:d", lambda s, d: decimate.pyramid_level(tel(s, d), "speed", 64), _TEL + ", i AS (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY t) - 1 AS n FROM tel);; SELECT vin, n // 64 AS bucket, min(t) AS t, min(speed) AS low, max(speed) AS high FROM i GROUP BY vin, n // 64"),
    "select_series": Query(
        "vin:l x:d y:d", lambda s, d: decimate.select_series(x := cut(tel(s, d), "rows"), "speed", _series_windows(x), 200),
        _TEL + """, i AS (SELECT vin, t, speed, row_number() OVER (PARTITION BY vin ORDER BY t) - 1 AS n FROM tel), e AS (SELECT vin, min(t) + 1000 AS ft, max(t) - 2000 AS tt FROM tel GROUP BY vin),
z AS (SELECT vin, ft, tt, count(*) AS c, min(n) FILTER (t >= ft) AS a, max(n) FILTER (t <= tt) + 1 AS b FROM i JOIN e USING (vin) GROUP BY vin, ft, tt),
f AS (SELECT *, CASE WHEN b - a <= 200 THEN 1 ELSE coalesce(list_min(list_filter([4, 16, 64, 256, 1024, 4096, 16384, 65536], lambda x: c >= 2 * x AND (b - a) / x <= 200)), list_max(list_filter([4, 16, 64, 256, 1024, 4096, 16384, 65536], lambda x: c >= 2 * x)), 1) END AS f FROM z WHERE b > a),
l AS (SELECT vin, n // f AS k, min(t) AS t, min(speed) AS lo, max(speed) AS hi, any_value(f) AS f, any_value(a) AS a, any_value(b) AS b FROM i JOIN f USING (vin) WHERE f > 1 GROUP BY vin, n // f),
m AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY vin ORDER BY k), t + f) AS nx FROM l), w AS (SELECT * FROM m WHERE k >= a // f AND k < ceil(b / f));;
SELECT vin, t AS x, lo AS y FROM w UNION ALL SELECT vin, t + greatest(1, (nx - t) / 2), hi FROM w UNION ALL SELECT vin, t, speed FROM i JOIN f USING (vin) WHERE f = 1 AND t BETWEEN ft AND tt""",
    ),
    "break_at_gaps": Query("vin:l t:l y:d", lambda s, d: spans.break_at_gaps(ev(s, d).withColumnRenamed("value", "y"), 36000), _EV + ", b AS (SELECT *, lag(t) OVER (PARTITION BY vin ORDER BY t) AS p FROM ev);; SELECT vin, t, value AS y FROM b UNION ALL SELECT vin, p + 1, NULL FROM b WHERE t - p > 36000"),
    "csv_window": Query("vin:l time:s speed:d soc:d", lambda s, d: decimate.export_window(tel(s, d), ["speed", "soc"]), _TEL + ";; SELECT vin, strftime(TIMESTAMP '1970-01-01' + to_seconds(t), '%Y-%m-%dT%H:%M:%S') || '.000Z' AS time, speed, soc FROM tel"),
    "labels": Query("t:l a:s b:s c:s", lambda s, d: ev(s, d).select("t", numbers.mask_vin(F.concat(F.lit("VIN"), F.col("t").cast("string"))).alias("a"), labels.duration_label(F.col("t") % 9000 - F.col("t") % 60).alias("b"), tm.hour_label(F.col("t") % 24).alias("c")).distinct(), _EV + ", x AS (SELECT DISTINCT t, t % 9000 - t % 60 AS s FROM ev), y AS (SELECT *, CAST(floor((s % 3600) / 60 + 0.5) AS INT) AS m FROM x);; SELECT t, 'VIN' || left(CAST(t AS VARCHAR), 1) || ' … ' || right(CAST(t AS VARCHAR), 4) AS a, CASE WHEN s <= 0 THEN '—' WHEN s >= 3600 THEN (s // 3600) || ' h ' || lpad(CAST(m AS VARCHAR), 2, '0') || ' min' ELSE m || ' min' END AS b, lpad(CAST(t % 24 AS VARCHAR), 2, '0') || ':00' AS c FROM y"),
    "number_labels": Query(
        "t:l num:s measure:s percent:s money:s bytes:s", lambda s, d: _figures(ev(s, d)).select("t", labels.number_label(F.col("n"), 1).alias("num"), labels.measure_label(F.col("n"), "km").alias("measure"), labels.percent_label(F.col("n") / 1024, 1).alias("percent"), labels.money_label(F.col("n") / 16).alias("money"), labels.bytes_label(F.col("n") * F.col("n")).alias("bytes")),
        _EV + """, x AS (SELECT DISTINCT t, CASE WHEN t % 11 > 0 THEN t % 100000 - 300 END AS n FROM ev), y AS (SELECT *, n * n AS b, n / 16 AS m FROM x);; SELECT t, CASE WHEN n IS NULL THEN '—' ELSE format('{:,.1f}', CAST(n AS DOUBLE)) END AS num, CASE WHEN n IS NULL THEN '—' ELSE format('{:,}', n) || ' km' END AS measure, CASE WHEN n IS NULL THEN '—' ELSE format('{:,.1f}', round(CAST(n AS DOUBLE) / 1024 * 100, 1)) || '%' END AS percent,
CASE WHEN n IS NULL THEN '—' ELSE CASE WHEN m < 0 THEN '-£' ELSE '£' END || CASE WHEN m >= 100 THEN format('{:,.0f}', round(abs(m), 0)) ELSE format('{:,.2f}', round(abs(m), 2)) END END AS money,
CASE WHEN n IS NULL OR b = 0 THEN '—' WHEN b < 1024 THEN format('{:,}', b) || ' B' WHEN b < 10 * 1024 THEN format('{:,.1f}', round(b / 1024, 1)) || ' kB' WHEN b < 1024 * 1024 THEN format('{:,.0f}', round(b / 1024, 0)) || ' kB' WHEN b < 10 * 1048576 THEN format('{:,.1f}', round(b / 1048576, 1)) || ' MB' WHEN b < 1073741824 THEN format('{:,.0f}', round(b / 1048576, 0)) || ' MB' WHEN b < 10737418240 THEN format('{:,.1f}', round(b / 1073741824, 1)) || ' GB' ELSE format('{:,.0f}', round(b / 1073741824, 0)) || ' GB' END AS bytes FROM y""",
    ),
    "span_labels": Query(
        "t:l clock:s short:s days:s", lambda s, d: _figures(ev(s, d)).select("t", labels.clock_label(F.col("n") - 20).alias("clock"), labels.clock_label(F.col("n") - 20, True).alias("short"), labels.long_label(F.col("n") * 7).alias("days")),
        _EV + """, x AS (SELECT DISTINCT t, CASE WHEN t % 11 > 0 THEN t % 100000 - 300 END AS n FROM ev), y AS (SELECT *, n - 20 AS s, n * 7 AS l FROM x);; SELECT t, CASE WHEN s IS NULL OR s < 0 THEN '—' WHEN s >= 3600 THEN (s // 3600) || ' h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ' min' WHEN s >= 60 THEN (s // 60) || ' min' ELSE s || ' s' END AS clock, CASE WHEN s IS NULL OR s < 0 THEN '—' WHEN s >= 3600 THEN (s // 3600) || 'h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' WHEN s >= 60 THEN (s // 60) || 'm' ELSE s || ' s' END AS short,
CASE WHEN l IS NULL OR l < 0 THEN '—' WHEN l >= 86400 THEN (l // 86400) || ' d ' || CAST(floor((l % 86400) / 3600 + 0.5) AS INT) || ' h' WHEN l >= 3600 THEN (l // 3600) || ' h ' || lpad(CAST(l % 3600 // 60 AS VARCHAR), 2, '0') || ' min' WHEN l >= 60 THEN (l // 60) || ' min' ELSE l || ' s' END AS days FROM y""",
    ),
    "date_labels": Query(
        "t:l moment:s full:s hour:s date:s day:s weekday:s", lambda s, d: ev(s, d).select("t", labels.moment_label("t", TZ).alias("moment"), labels.full_moment_label("t", TZ).alias("full"), labels.time_label("t", TZ).alias("hour"), labels.date_label("t", TZ).alias("date"), labels.day_label(tm.local_date("t", TZ)).alias("day"), labels.day_name(tm.weekday("t", TZ)).alias("weekday")).distinct(),
        _EV + f", x AS (SELECT DISTINCT t, {LOCAL('t')} AS l FROM ev);; SELECT t, strftime(l, '%-d %b, %H:%M') AS moment, strftime(l, '%A %-d %B at %H:%M') AS \"full\", strftime(l, '%H:%M') AS hour, strftime(l, '%-d %b %Y') AS date, strftime(l, '%a, %-d %b') AS day, strftime(l, '%A') AS weekday FROM x",
    ),
    "code_labels": Query("vin:l gear:s door:s", lambda s, d: tel(s, d).select("vin", labels.gear_label(F.col("gear")).alias("gear"), labels.door_label(F.when(F.col("gear") == 1, "ldcu_rldoorajarst").otherwise("x")).alias("door")).distinct(), _TEL + ";; SELECT DISTINCT vin, CASE gear WHEN 1 THEN 'D' WHEN 2 THEN 'N' WHEN 3 THEN 'R' WHEN 4 THEN 'P' END AS gear, CASE gear WHEN 1 THEN 'Rear left' ELSE 'x' END AS door FROM tel"),
    "analysis_header": Query(
        "vin:l window_days:l rows:l coverage_s:l recorded_s:l recorded_days:l sources:l odo_start:l odo_end:l", lambda s, d: facts.header(x := cut(hab(s, d), "rows"), _span(x), TZ, x.groupBy("vin").agg(F.count_distinct(F.col("vin") % 2 + F.col("t") % 2).alias("n")).where("vin > 0")),
        _ON_HAB(_AW) + f""", c AS (SELECT vin, sum(end_t - start_t) AS cs FROM sp GROUP BY vin), b AS (SELECT vin, min(t) AS a, max(t) AS b FROM tel GROUP BY vin), dy AS (SELECT DISTINCT vin, CAST({LOCAL('u')} AS DATE) AS day FROM (SELECT vin, unnest(range(a, b + 43201, 43200)) AS u FROM b)),
rd AS (SELECT vin, count(*) AS n FROM dy JOIN b USING (vin) WHERE b.a < epoch(CAST(dy.day AS TIMESTAMP) AT TIME ZONE '{TZ}') + 86400 AND b.b > epoch(CAST(dy.day AS TIMESTAMP) AT TIME ZONE '{TZ}') GROUP BY vin);;
SELECT vin, greatest(1, floor((max(t) - min(t)) / 86400.0 + 0.5)) AS window_days, count(*) AS rows, any_value(cs) AS coverage_s, greatest(1, max(t) - min(t)) AS recorded_s, any_value(rd.n) AS recorded_days, CASE WHEN vin > 0 THEN 2 ELSE 1 END AS sources, min(odo) AS odo_start, max(odo) AS odo_end FROM tel JOIN c USING (vin) JOIN rd USING (vin) GROUP BY vin""",
    ),
    "overview": Query(
        "vin:l km:d moving_s:l kwh:d kwh_100km:d cost:d soc_min:l soc_max:l signals:l seconds_fast:l", lambda s, d: facts.overview((a := _analysed(tel(s, d)))[0].withColumn("speed", F.col("speed") * 2), *a[1:3]),
        _BOTH + """, tt AS (SELECT vin, sum(km) AS km, sum(moving_s) AS moving_s FROM trips GROUP BY vin), ss AS (SELECT vin, sum(kwh) AS kwh FROM sessions GROUP BY vin), b AS (SELECT vin, min(soc) AS soc_min, max(soc) AS soc_max FROM tel GROUP BY vin),
ff AS (SELECT vin, sum(coalesce(t - pt, 1)) AS n FROM gp WHERE speed * 2 >= 100 AND coalesce(t - pt, 1) BETWEEN 1 AND 10 GROUP BY vin);;
SELECT b.*, coalesce(km, 0) AS km, coalesce(moving_s, 0) AS moving_s, coalesce(kwh, 0) AS kwh, coalesce(kwh, 0) / km * 100 AS kwh_100km, coalesce(kwh, 0) * 0.32 AS cost, 9 AS signals, coalesce(n, 0) AS seconds_fast FROM b LEFT JOIN tt USING (vin) LEFT JOIN ss USING (vin) LEFT JOIN ff USING (vin)""",
    ),
    "facts": Query(
        "vin:l id:s tone:s value:d", _facts,
        "RECURSIVE " + _ON_HAB(_BOTH) + _LIMITS + _ALL_TYRES + ", ok AS (SELECT vin, t, (soc * 4.0 + t % 50) / soc * 100 AS v FROM tel WHERE soc BETWEEN 30 AND 95 AND soc * 4.0 + t % 50 > 0), " + _stride("ok", 600, "vin") + _DOORS.removeprefix(_TEL) + _DRAIN + f""", tt AS (SELECT vin, sum(km) AS km, sum(moving_s) AS mv, max(max_speed) AS ms, count(*) AS n, max(km) AS lk FROM trips GROUP BY vin), ss AS (SELECT vin, sum(kwh) AS kwh, count(*) AS n, max(CAST(is_dc AS INT)) AS dc, max(max_kw) AS mk FROM sessions GROUP BY vin),
hh AS (SELECT vin, hour({LOCAL('start_t')}) AS h, count(*) AS n FROM trips GROUP BY ALL), hr AS (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY n DESC, h) AS r, sum(n) OVER (PARTITION BY vin) AS tot FROM hh),
bd AS (SELECT vin, max(km) AS km FROM (SELECT vin, CAST({LOCAL('start_t')} AS DATE) AS d, sum(km) AS km FROM trips GROUP BY ALL) GROUP BY vin),
cm AS (SELECT vin, count(*) FILTER (hour({LOCAL('start_t')}) BETWEEN 5 AND 9) AS m, count(*) FILTER (hour({LOCAL('start_t')}) BETWEEN 15 AND 19) AS e, count(*) AS n FROM trips GROUP BY vin),
ch AS (SELECT vin, hour({LOCAL('start_t')}) AS h, count(*) AS n FROM sessions GROUP BY ALL), cr AS (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY n DESC, h) AS r, sum(n) OVER (PARTITION BY vin) AS tot FROM ch), cs AS (SELECT *, tot >= 4 AND n >= 3 AND n / tot >= 0.3 AS timed FROM cr WHERE r = 1),
dm AS (SELECT vin, count(*) AS n FROM (SELECT DISTINCT vin, CAST({LOCAL('u')} AS DATE) AS day FROM (SELECT vin, unnest(range(a, b + 43201, 43200)) AS u FROM (SELECT vin, min(t) AS a, max(t) AS b FROM tel GROUP BY vin))) q JOIN (SELECT vin AS v, min(t) AS a, max(t) AS b FROM tel GROUP BY vin) z ON q.vin = z.v
  WHERE z.a < epoch(CAST(q.day AS TIMESTAMP) AT TIME ZONE '{TZ}') + 86400 AND z.b > epoch(CAST(q.day AS TIMESTAMP) AT TIME ZONE '{TZ}') AND NOT EXISTS (SELECT 1 FROM trips y WHERE y.vin = q.vin AND CAST({LOCAL('y.start_t')} AS DATE) = q.day AND y.km > 0) GROUP BY vin);;
SELECT vin, 'distance' AS id, 'headline' AS tone, km AS value FROM tt WHERE km > 0 UNION ALL SELECT vin, 'time-driving', 'headline', mv FROM tt WHERE mv > 0 UNION ALL SELECT vin, 'top-speed', 'headline', ms FROM tt WHERE ms > 0 UNION ALL SELECT vin, 'longest-trip', 'headline', lk FROM tt
UNION ALL SELECT vin, 'energy-charged', 'headline', kwh FROM ss WHERE kwh > 0 UNION ALL SELECT vin, 'departure-rhythm', 'habit', h FROM hr WHERE r = 1 AND tot >= 4 UNION ALL SELECT vin, 'ac-only', 'habit', mk FROM ss WHERE dc = 0 UNION ALL SELECT vin, 'busiest-day', 'habit', km FROM bd WHERE km > 0
UNION ALL SELECT vin, 'hardest-brake', 'headline', abs(min(curr)) FROM tel GROUP BY vin UNION ALL SELECT vin, 'commute-shape', 'habit', m + e FROM cm WHERE n >= 4 AND m >= 5 AND e >= 5 AND m + e > n * 0.5
UNION ALL SELECT vin, 'scheduled-charging', 'habit', h FROM cs WHERE timed UNION ALL SELECT vin, 'plug-in-habit', 'habit', h FROM cs WHERE NOT timed AND tot >= 5 UNION ALL SELECT vin, 'charge-limit', 'habit', l FROM lb WHERE r = 1 AND n >= 3 AND l < 99
UNION ALL SELECT vin, 'idle-days', 'habit', n FROM dm UNION ALL SELECT vin, 'phantom-drain', 'habit', sum(soc_start - soc_end) / sum(hours) * 24 FROM dz WHERE soc_start >= soc_end GROUP BY vin HAVING count(*) > 2
UNION ALL SELECT vin, 'implied-range', 'habit', list_sort(list(v))[CAST(least(count(*), floor(count(*) * 0.5) + 1) AS BIGINT)] FROM picked GROUP BY vin UNION ALL SELECT vin, unnest(['door-rhythm', 'routine-exposure']), unnest(['habit', 'privacy']), count(*) FROM doors GROUP BY vin
UNION ALL SELECT DISTINCT vin, 'empty-columns', 'quirk', 1 FROM tel WHERE vin = 2 UNION ALL SELECT vin, 'duplicate-rows', 'quirk', count(*) FROM tel WHERE t % 5 = 0 GROUP BY vin UNION ALL SELECT vin, 'vin-repetition', 'privacy', count(*) + count(*) FILTER (t % 5 = 0) FROM tel GROUP BY vin
UNION ALL SELECT DISTINCT vin, unnest(['beijing-time', 'second-resolution']), unnest(['quirk', 'privacy']), unnest([18, 1]) FROM tel UNION ALL SELECT vin, 'pack-spread', 'quirk', max(speed - curr) FROM tel GROUP BY vin HAVING max(speed - curr) > 0
UNION ALL SELECT vin, 'tyre-weather', 'quirk', r FROM tyr WHERE abs(r) > 0.3 UNION ALL SELECT vin, 'sample-count', 'quirk', count(*) FROM tel GROUP BY vin UNION ALL SELECT vin, 'no-gps', 'privacy', NULL FROM tel GROUP BY vin""",
    ),
}
