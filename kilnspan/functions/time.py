"""Time functions that do not depend on the session's time zone: instants are epoch seconds, local times are TIMESTAMP_NTZ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _sql(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch(ts: str) -> Column:
    """Whole epoch seconds of a TIMESTAMP_NTZ column that holds UTC."""
    return F.expr(f"timestampdiff(SECOND, {EPOCH}, `{ts}`)")


def local(t: str, tz: str) -> Column:
    return F.expr(f"convert_timezone('UTC', '{tz}', timestampadd(SECOND, `{t}`, {EPOCH}))")


def local_date(t: str, tz: str) -> Column:
    return F.to_date(local(t, tz))


def local_hour(t: str, tz: str) -> Column:
    return F.hour(local(t, tz))


def weekday(t: str, tz: str) -> Column:
    """0 is Sunday."""
    return F.dayofweek(local(t, tz)) - 1


def day_start(day: str, tz: str) -> Column:
    """First second of a local date."""
    return F.expr(f"timestampdiff(SECOND, {EPOCH}, convert_timezone('{tz}', 'UTC', cast(`{day}` as timestamp_ntz)))")


def zone_offset(t: str, tz: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, {EPOCH}, convert_timezone('UTC', '{tz}', timestampadd(SECOND, `{t}`, {EPOCH})))") - F.col(t)


def hour_label(h: Column) -> Column:
    return F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":00"))
