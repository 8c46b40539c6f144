"""Which child a value belongs to: truncation, grids, names and initial boundaries."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from .intervals import DAY, SECOND, Interval, add

NAME_BYTES = 63
YEARS = {"decade": 10, "century": 100, "millennium": 1000}


def datetime_string(interval: Interval) -> str:
    return "YYYYMMDD" if interval.cmp_key() >= DAY else "YYYYMMDD_HH24MISS"


def format_suffix(t: datetime, pattern: str) -> str:
    day = f"{t.year:04d}{t.month:02d}{t.day:02d}"
    return day if pattern == "YYYYMMDD" else f"{day}_{t.hour:02d}{t.minute:02d}{t.second:02d}"


def truncate(t: datetime, unit: str) -> datetime:
    """Start of the unit; centuries and millennia begin at year ...01."""
    if unit == "week":
        return truncate(t, "day").fromordinal(t.toordinal() - t.weekday())
    if unit == "quarter":
        return datetime(t.year, (t.month - 1) // 3 * 3 + 1, 1)
    if unit in YEARS:
        n = YEARS[unit]
        year = t.year - t.year % n if unit == "decade" else (t.year - 1) // n * n + 1
        return datetime(max(year, 1), 1, 1)
    keep = ("year", "month", "day", "hour", "minute", "second").index(unit) + 1
    parts = [t.year, t.month, t.day, t.hour, t.minute, t.second]
    return datetime(*(parts[:keep] + [1, 1, 1, 0, 0, 0][keep:]))


def truncation_unit(interval: Interval) -> str:
    months = interval.cmp_key() / (30 * DAY)
    for unit, least in (("millennium", 12_000), ("century", 1_200), ("decade", 120), ("year", 12), ("month", 1)):
        if months >= least:
            return unit
    for unit, least in (("day", DAY), ("hour", 60 * SECOND)):
        if interval.cmp_key() >= least:
            return unit
    return "minute"


def time_partition_info(interval: Interval, start: datetime, date_trunc_interval: str | None = None) -> tuple[datetime, str]:
    """(base timestamp, suffix pattern) of a set that starts at ``start``."""
    return truncate(start, date_trunc_interval or truncation_unit(interval)), datetime_string(interval)


def check_name_length(name: str, suffix: str | None = None, table_partition: bool = False) -> str:
    """The name with its suffix, cut to 63 bytes so that the suffix stays whole."""
    if not name:
        raise ValueError("a name is needed")
    if table_partition and not suffix:
        raise ValueError("a partition's name needs a suffix")
    end = f"{'_p' if table_partition else ''}{suffix or ''}"
    return name.encode()[: NAME_BYTES - len(end.encode())].decode(errors="ignore") + end


def trunc_div(a: int, b: int) -> int:
    """Whole division towards zero."""
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


def trunc_mod(a: int, b: int) -> int:
    """Remainder with the sign of the dividend."""
    return a - b * trunc_div(a, b)


@dataclass(frozen=True)
class TimeGrid:
    """Cells [anchor + n * interval, anchor + (n + 1) * interval)."""

    interval: Interval
    anchor: datetime

    def __post_init__(self) -> None:
        if self.interval.months and self.anchor.day > 28:
            raise ValueError("a set of months or years must start on day 28 of a month at most")
        if self.interval.months and (self.interval.days or self.interval.micros):
            raise ValueError("months can't be mixed with days or time in an interval")

    def index(self, t: datetime) -> int:
        if self.interval.fixed():
            return (t - self.anchor) // self.interval.length()
        a = self.anchor
        months = (t.year - a.year) * 12 + t.month - a.month
        if (t.day, t.time()) < (a.day, a.time()):
            months -= 1
        return months // self.interval.months

    def lo(self, n: int) -> datetime:
        return add(self.anchor, self.interval, n)

    def cell(self, t: datetime) -> tuple[datetime, datetime]:
        n = self.index(t)
        return self.lo(n), self.lo(n + 1)


@dataclass(frozen=True)
class IdGrid:
    step: int
    anchor: int = 0

    def index(self, v: int) -> int:
        return (v - self.anchor) // self.step

    def lo(self, n: int) -> int:
        return self.anchor + n * self.step

    def cell(self, v: int) -> tuple[int, int]:
        n = self.index(v)
        return self.lo(n), self.lo(n + 1)


def initial_times(interval: Interval, now: datetime, premake: int, start: datetime | None, date_trunc_interval: str | None) -> tuple[list[datetime], str]:
    """Boundaries of a new time set: from the truncated start while before now + premake intervals."""
    first = start if start is not None else add(now, interval, -premake)
    base, pattern = time_partition_info(interval, first, date_trunc_interval)
    out = [base]
    try:
        limit = add(now, interval, premake)
    except OverflowError:
        limit = datetime.max
    grid, n = TimeGrid(interval, base), 1
    while True:
        try:
            t = grid.lo(n)
        except OverflowError:
            break
        if t >= limit:
            break
        out.append(t)
        n += 1
    return out, pattern


def initial_ids(step: int, highest: int | None, premake: int, start: int | None) -> list[int]:
    """Boundaries of a new id set: around the highest value, or from a given start."""
    top = start if start is not None else (highest or 0)
    first = top - trunc_mod(top, step)
    before = [first - i * step for i in range(premake, 0, -1) if first - i * step > 0] if start is None else []
    return before + [first + i * step for i in range(premake + 1)]
