"""A made-up month of driving, for demonstrations and as a check of the whole analysis: what it simulates has to be found again.

A vehicle's life is a list of episodes (drives, charges, wake-ups); each vehicle is played by one task, an episode at a time, from a seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .registry import SIGNALS

#: kWh of the pack, kg of the car, percent that charging stops at, percent lost in a day of standing, local hour of the charging timer.
PACK, MASS, LIMIT, STANDBY, TIMER = 80.0, 2100.0, 90.0, 1.4, 2
#: Seconds between the starts of wake-ups, and seconds that one lasts.
WAKE_EVERY, WAKE = 35 * 60, 13 * 60
EMPTY = ("ldcu_flwinposstfb", "ldcu_rlwinposstfb", "frwinposstfb", "rrwinposstfb", "rdm_tropenersts")
_DOORS = ("ldcu_driverdoorajarst", "rdcu_psngrdoorajarst", "ldcu_rldoorajarst", "rdcu_rrdoorajarst")


@dataclass
class _Car:
    """The state that goes from one episode to the next, and the rows played so far."""

    awd: bool
    r: np.random.Generator
    soc: float = 72.0
    odo: float = 3000.0
    warm: float = 15.0
    at: int = 0
    out: list[dict[str, np.ndarray]] = field(default_factory=list)

    def _rows(self, n: int, soc_end: float, **signals: np.ndarray) -> None:
        """n seconds from now; signals that are not given stand still."""
        soc = np.linspace(self.soc, soc_end, n)
        warm = self.warm + self.r.normal(0, 0.3, n)
        rows = {
            "t": self.at + np.arange(n), "esp_vehspd": np.zeros(n), "esp_vehlongaccel": np.zeros(n), "esp_vehlateralaccel": np.zeros(n), "cdcu_totalodometer": np.full(n, np.floor(self.odo)),
            "eps_steeringangle": np.zeros(n), "eps_steeringanglespd": np.zeros(n), "ldcu_accpedalsig": np.zeros(n), "ldcu_brkpedalst": np.zeros(n), "ldcu_currentgearlev": np.full(n, 4.0),
            "bms_battvolt": 360 + soc * 0.6, "bms_battcurr": np.full(n, 0.9), "ldcu_chrgpwr": np.zeros(n), "ldcu_bms_soc_disp": np.round(soc), "ldcu_dstbatdisp_dynamic": np.round(soc * (4.2 + 0.05 * (self.warm - 15)), 1),
            "bms_batttempmax_gb": np.round(warm + 3), "bms_batttempmin_gb": np.round(warm), **{d: np.zeros(n) for d in _DOORS},
        } | signals
        wheels = {f"ldcu_tpmsprf{s}" if s in "lr" else f"ldcu_tpmspr{s}": np.full(n, 250 + 0.25 * round(4 * (0.9 * (self.warm - 15) + k))) for k, s in enumerate(("l", "r", "rl", "rr"))}
        for axle in ("ipur", "ipuf") if self.awd else ("ipur",):
            share = 0.6 if axle == "ipur" else 0.4
            rows |= {f"{axle}_actrotspd": rows["esp_vehspd"] * 80, f"{axle}_acttorq": np.round(rows["esp_vehlongaccel"] * 900 * share * 4) / 4, f"{axle}_rotoracttemp": np.round(warm + 15)}
        self.out.append(rows | wheels)
        self.soc, self.at = soc_end, self.at + n

    def drive(self, minutes: float, cruise: float, stops: int) -> None:
        """Legs from standstill to standstill; the doors open before and after."""
        opened = lambda n: np.where((np.arange(n) >= 5) & (np.arange(n) < 5 + n // 3), 1.0, 0.0)
        self._rows(40, self.soc, ldcu_driverdoorajarst=opened(40))
        for size in (self.r.dirichlet(np.full(stops + 1, 4.0)) * minutes * 60).astype(int) + 20:
            x = np.arange(size)
            top = cruise * self.r.uniform(0.7, 1.15)
            speed = np.clip(np.minimum(np.minimum(top, self.r.uniform(5, 9) * x), self.r.uniform(9, 15) * (size - 1 - x)), 0, None)
            speed = np.round(np.where(speed >= top, top + 2 * np.sin(x / 17), speed))
            change = np.diff(speed, prepend=0.0) / 3.6  # m/s each second
            metres = speed / 3.6
            push = MASS * change * metres / 1000
            power = 0.9 + speed * (0.10 + 0.0000115 * speed**2) * (1 + 0.006 * (15 - self.warm)) + np.where(push > 0, push / 0.9, push * 0.6)
            power = np.clip(power, -90, 250)
            odo = self.odo + np.cumsum(speed) / 3600
            soc_end = max(4.0, self.soc - power.sum() / 3600 / PACK * 100)
            bend = np.sin(x / 23) * 40 * (speed > 0)
            self._rows(
                size, soc_end, esp_vehspd=speed, esp_vehlongaccel=change / 9.81, esp_vehlateralaccel=np.clip(bend * speed / 40000, -0.5, 0.5), cdcu_totalodometer=np.floor(odo), eps_steeringangle=np.round(bend, 1), eps_steeringanglespd=np.round(np.abs(np.diff(bend, prepend=0.0))),
                ldcu_accpedalsig=np.round(np.clip(power, 0, 100)), ldcu_brkpedalst=(change < -1.5).astype(float), ldcu_currentgearlev=np.full(size, 1.0), bms_battcurr=np.round(power * 1000 / (360 + self.soc * 0.6), 1),
            )
            self.odo = float(odo[-1])
        self._rows(50, self.soc, ldcu_driverdoorajarst=opened(50), rdcu_psngrdoorajarst=opened(50) * (self.r.random() < 0.3))

    def charge(self, kw: float, to: float) -> None:
        n = int((to - self.soc) / 100 * PACK / kw * 3600)
        if n > 600:
            volt = 360 + np.linspace(self.soc, to, n) * 0.6
            self._rows(n, to, ldcu_chrgpwr=np.full(n, kw), bms_battcurr=np.round(-kw * 1000 / volt, 1))

    def stand(self, until: int) -> None:
        """Asleep but for wake-ups until then; a little charge goes."""
        start, lost = self.at, self.soc - STANDBY / 86400 * max(0, until - self.at)
        for wake in range(start + WAKE_EVERY, until - WAKE, WAKE_EVERY):
            self.at = wake
            self._rows(WAKE, self.soc - STANDBY / 86400 * WAKE_EVERY)
        self.soc, self.at = max(3.0, min(self.soc, lost)), max(self.at, until)


def _month(car: _Car, days: int, end_t: int, tz: str) -> Iterator[dict[str, np.ndarray]]:
    zone = ZoneInfo(tz)
    last = datetime.fromtimestamp(end_t, zone).replace(hour=0, minute=0, second=0, microsecond=0)
    trips = {int(d) for d in car.r.choice(np.arange(3, max(4, days - 2)), 2)}
    for k in range(days):
        day = last - timedelta(days=days - k)
        at = lambda hour, spread=0.0: int((day + timedelta(hours=hour)).timestamp() + car.r.normal(0, spread) * 60)  # noqa: B023, E731
        car.warm = 15 + 8 * np.sin(k / 4.5) + car.r.normal(0, 1.5)
        car.at = car.at or at(0.5)
        if car.soc < 62 or k + 1 in trips or k in trips:
            car.stand(at(TIMER) + 30)
            car.charge(11.0, LIMIT)
        if k in trips:
            for hour in (9, 16):
                car.stand(at(hour, 10))
                car.drive(70, 105, 5)
                car.charge(110.0, min(84.0, car.soc + 38))
                car.drive(50, 105, 4)
        elif day.weekday() < 5:
            car.stand(at(7.5, 12))
            car.drive(32, 52, 14)
            car.stand(at(17.25, 20))
            car.drive(36, 50, 16)
        if k not in trips and car.r.random() < 0.45:
            car.stand(at(19.6 if day.weekday() < 5 else 11.5, 15))
            car.drive(14, 42, 7)
        yield from car.out
        car.out.clear()
    car.stand(int(last.timestamp()))
    yield from car.out


def demo(spark: SparkSession, vehicles: int = 1, seed: int = 20260901, awd: bool = True, days: int = 30, end_t: int = 1788300000, tz: str = "Europe/Berlin") -> DataFrame:
    """(vin, vmodel, t, signals) of whole local days before end_t: commutes, errands, road trips with a fast charge, and a timer that charges at night.

    The same seed gives the same rows. Windows and tailgate never report, nor does the front motor without awd. Every second is there once.
    """
    names = list(SIGNALS)
    schema = "vin string, vmodel string, t long, " + ", ".join(f"{n} double" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for v in b.column(0).to_pylist():
                car = _Car(awd, np.random.default_rng([seed, v]))
                for rows in _month(car, days, end_t, tz):
                    n = len(rows["t"])
                    columns = [pa.array([f"L1DEMO{v:011d}"] * n), pa.array(["F30b"] * n), pa.array(rows["t"].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array(rows[c].astype(float)) if c in rows else pa.nulls(n, pa.float64()) for c in names)], ["vin", "vmodel", "t", *names])

    return spark.range(0, vehicles, 1, vehicles).mapInArrow(run, schema)
