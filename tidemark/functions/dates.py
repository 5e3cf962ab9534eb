"""Instants and calendar periods."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the one notation whose instants count for dated queries.
STRICT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,3})?)?(Z|[+-]\d{2}:\d{2})$"


def event_ms(ts: Column) -> Column:
    """Milliseconds of a strict ISO text with a zone; null for anything else."""
    return F.when(ts.rlike(STRICT), F.unix_millis(F.try_to_timestamp(ts)))


def _start(d: date, zone: str) -> int:
    z = ZoneInfo(zone)
    at = datetime(d.year, d.month, d.day, tzinfo=z)
    ms = int(at.timestamp() * 1000)
    back = datetime.fromtimestamp(ms / 1000, z)
    if (back.hour, back.minute, back.date()) != (0, 0, d):
        raise ValueError(f"{d} has no midnight in {zone}")
    return ms


def period(value: str, zone: str = "UTC", now_ms: int | None = None) -> tuple[int, int]:
    """[start, end) of YYYY, YYYY-MM, YYYY-MM-DD, today, yesterday or a zoned instant (one millisecond)."""
    ZoneInfo(zone)
    if value in ("today", "yesterday"):
        now = datetime.fromtimestamp((now_ms or int(datetime.now(timezone.utc).timestamp() * 1000)) / 1000, ZoneInfo(zone)).date()
        day = now - timedelta(days=value == "yesterday")
        return _start(day, zone), _start(day + timedelta(days=1), zone)
    if m := re.fullmatch(r"(\d{4})(?:-(\d\d)(?:-(\d\d))?)?", value):
        y, mo, d = int(m[1]), int(m[2] or 1), int(m[3] or 1)
        first = date(y, mo, d)  # raises for days that don't exist
        nxt = first + timedelta(days=1) if m[3] else date(y + mo // 12, mo % 12 + 1, 1) if m[2] else date(y + 1, 1, 1)
        return _start(first, zone), _start(nxt, zone)
    if re.match(STRICT, value):
        ms = round(datetime.fromisoformat(value.replace("Z", "+00:00")).timestamp() * 1000)
        return ms, ms + 1
    raise ValueError(f"not a date: {value}")


def last_week(zone: str, now_ms: int) -> tuple[int, int]:
    """Monday to Sunday before the current week."""
    d = datetime.fromtimestamp(now_ms / 1000, ZoneInfo(zone)).date()
    monday = d - timedelta(days=d.weekday() + 7)
    return _start(monday, zone), _start(monday + timedelta(days=7), zone)


def date_range(zone: str = "UTC", now_ms: int | None = None, on=None, since=None, until=None, before=None, after=None) -> tuple[int | None, int | None]:
    """[lo, hi) of the given bounds; contradictions are errors, not empty results."""
    if on and (since or until or before or after):
        raise ValueError("on can't go with other bounds")
    if (since and after) or (until and before):
        raise ValueError("two bounds on one side")
    if on:
        return period(on, zone, now_ms)
    lo = period(since, zone, now_ms)[0] if since else period(after, zone, now_ms)[1] if after else None
    hi = period(until, zone, now_ms)[1] if until else period(before, zone, now_ms)[0] if before else None
    if lo is not None and hi is not None and lo >= hi:
        raise ValueError("the range ends before it begins")
    return lo, hi
