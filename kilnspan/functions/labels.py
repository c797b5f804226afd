"""Numbers, durations and dates as a reader sees them: British English, a dash for what is not there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import half_up
from .time import local

DASH = "—"
#: Names by number.
DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
GEARS = {1: "D", 2: "N", 3: "R", 4: "P"}
DOORS = {"ldcu_driverdoorajarst": "Driver", "rdcu_psngrdoorajarst": "Passenger", "ldcu_rldoorajarst": "Rear left", "rdcu_rrdoorajarst": "Rear right"}


def _or_dash(known: Column, label: Column) -> Column:
    return F.when(F.coalesce(known, F.lit(False)), label).otherwise(F.lit(DASH))


def _finite(c: Column) -> Column:
    x = c.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _fixed(c: Column, digits: int) -> Column:
    """Grouped thousands and this many decimals, halves away from zero."""
    return F.format_number(F.round(c.cast("double"), digits), digits)


def number_label(c: Column, digits: int = 0) -> Column:
    return _or_dash(_finite(c), _fixed(c, digits))


def measure_label(c: Column, unit: str, digits: int = 0) -> Column:
    return _or_dash(_finite(c), F.concat(_fixed(c, digits), F.lit(f" {unit}" if unit else "")))


def percent_label(share: Column, digits: int = 0) -> Column:
    return _or_dash(_finite(share), F.concat(_fixed(share * 100, digits), F.lit("%")))


def money_label(amount: Column, sign: str = "£") -> Column:
    """Whole units from 100 on, else two decimals; the sign follows a minus."""
    size = F.abs(amount.cast("double"))
    digits = F.when(amount >= 100, _fixed(size, 0)).otherwise(_fixed(size, 2))
    return _or_dash(_finite(amount), F.concat(F.when(amount < 0, F.lit("-")).otherwise(F.lit("")), F.lit(sign), digits))


def bytes_label(n: Column) -> Column:
    """Units of 1024; one decimal below ten, but none for bytes."""
    v = n.cast("double")
    out = F.concat(_fixed(v, 0), F.lit(" B"))
    for k, unit in enumerate(("kB", "MB", "GB"), 1):
        x = v / F.lit(float(1024**k))
        out = F.when(v >= 1024**k, F.concat(F.when(x < 10, _fixed(x, 1)).otherwise(_fixed(x, 0)), F.lit(f" {unit}"))).otherwise(out)
    return _or_dash(_finite(n) & (v > 0), out)


def duration_label(s: Column) -> Column:
    """Hours and minutes of a fact, minutes rounded; a dash for nothing."""
    h, m = F.floor(s / 3600), half_up(s % 3600 / 60)
    return _or_dash(s > 0, F.when(h > 0, F.format_string("%d h %02d min", h, m)).otherwise(F.format_string("%d min", m)))


def clock_label(s: Column, short: bool = False) -> Column:
    """Whole seconds below a minute, else minutes, else hours and minutes, all cut off."""
    total = half_up(s.cast("double"))
    h, m = F.floor(total / 3600), F.floor(total % 3600 / 60)
    hours, minutes = ("%dh %02dm", "%dm") if short else ("%d h %02d min", "%d min")
    return _or_dash(_finite(s) & (s >= 0), F.when(h > 0, F.format_string(hours, h, m)).when(m > 0, F.format_string(minutes, m)).otherwise(F.format_string("%d s", total)))


def long_label(s: Column) -> Column:
    """Days and rounded hours from a day on."""
    d = F.floor(s.cast("double") / 86400)
    return F.when(_finite(s) & (d >= 1), F.format_string("%d d %d h", d, half_up(s % 86400 / 3600))).otherwise(clock_label(s))


def day_name(n: Column) -> Column:
    """0 is Sunday."""
    return F.element_at(F.array(*map(F.lit, DAYS)), (n + 1).cast("int"))


def month_name(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS)), n.cast("int"))


def gear_label(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in GEARS.items() for x in kv]), code.cast("int"))


def door_label(signal: Column) -> Column:
    """A door's name, or its signal's where it has none."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DOORS.items() for x in kv]), signal), signal)


def time_label(t: str, tz: str) -> Column:
    at = local(t, tz)
    return F.format_string("%02d:%02d", F.hour(at), F.minute(at))


def _day_month(at: Column, short: bool) -> Column:
    name = month_name(F.month(at))
    return F.concat(F.dayofmonth(at).cast("string"), F.lit(" "), F.left(name, F.lit(3)) if short else name)


def moment_label(t: str, tz: str) -> Column:
    """27 Aug, 14:05"""
    return F.concat(_day_month(local(t, tz), True), F.lit(", "), time_label(t, tz))


def full_moment_label(t: str, tz: str) -> Column:
    """Thursday 27 August at 14:05"""
    at = local(t, tz)
    return F.concat(day_name(F.dayofweek(at) - 1), F.lit(" "), _day_month(at, False), F.lit(" at "), time_label(t, tz))


def date_label(t: str, tz: str) -> Column:
    """27 Aug 2026"""
    at = local(t, tz)
    return F.concat(_day_month(at, True), F.lit(" "), F.year(at).cast("string"))


def day_label(day: Column) -> Column:
    """Thu, 27 Aug"""
    return F.concat(F.left(day_name(F.dayofweek(day) - 1), F.lit(3)), F.lit(", "), _day_month(day, True))
