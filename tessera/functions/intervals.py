"""Calendar intervals as (months, days, microseconds)."""

from __future__ import annotations

import re
from calendar import monthrange
from dataclasses import dataclass
from datetime import datetime, timedelta

SECOND = 1_000_000
DAY = 86_400 * SECOND

#: Unit -> (field, how many of the field's unit).
UNITS = {
    "microsecond": ("micros", 1),
    "millisecond": ("micros", 1_000),
    "second": ("micros", SECOND),
    "sec": ("micros", SECOND),
    "minute": ("micros", 60 * SECOND),
    "min": ("micros", 60 * SECOND),
    "hour": ("micros", 3_600 * SECOND),
    "day": ("days", 1),
    "week": ("days", 7),
    "month": ("months", 1),
    "mon": ("months", 1),
    "quarter": ("months", 3),
    "year": ("months", 12),
    "decade": ("months", 120),
    "century": ("months", 1_200),
    "centurie": ("months", 1_200),
    "millennium": ("months", 12_000),
}
_PART = re.compile(r"\s*([+-]?\d+)\s*([A-Za-z]+)|\s*([+-]?)(\d+):(\d{2})(?::(\d{2})(?:\.(\d{1,6}))?)?")


@dataclass(frozen=True)
class Interval:
    months: int = 0
    days: int = 0
    micros: int = 0

    @classmethod
    def parse(cls, text: str) -> Interval:
        out, at, text = {"months": 0, "days": 0, "micros": 0}, 0, text.strip()
        if not text:
            raise ValueError("empty interval")
        while at < len(text):
            m = _PART.match(text, at)
            if not m:
                raise ValueError(f"not an interval: {text!r}")
            if m[2]:
                unit = m[2].lower()
                unit = unit if unit in UNITS else unit.removesuffix("s")
                if unit not in UNITS:
                    raise ValueError(f"unknown unit in interval: {m[2]!r}")
                field, size = UNITS[unit]
                out[field] += int(m[1]) * size
            else:
                micros = (int(m[4]) * 3_600 + int(m[5]) * 60 + int(m[6] or 0)) * SECOND + int((m[7] or "").ljust(6, "0") or 0)
                out["micros"] += -micros if m[3] == "-" else micros
            at = m.end()
        return cls(**out)

    def __str__(self) -> str:
        def some(n: int, one: str) -> list[str]:
            return [f"{n} {one}{'' if n == 1 else 's'}"] if n else []

        years, months = int(self.months / 12), self.months - 12 * int(self.months / 12)
        parts = some(years, "year") + some(months, "mon") + some(self.days, "day")
        if self.micros or not parts:
            sign, m = ("-" if self.micros < 0 else ""), abs(self.micros)
            s, frac = divmod(m, SECOND)
            clock = f"{sign}{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
            parts.append(clock + (f".{frac:06d}".rstrip("0") if frac else ""))
        return " ".join(parts)

    def cmp_key(self) -> int:
        """Order of intervals: a month is 30 days, a day 24 hours."""
        return (self.months * 30 + self.days) * DAY + self.micros

    def __lt__(self, other: Interval) -> bool:
        return self.cmp_key() < other.cmp_key()

    def __le__(self, other: Interval) -> bool:
        return self.cmp_key() <= other.cmp_key()

    def epoch(self) -> float:
        """Seconds: a year is 365.25 days, a month of the rest 30 days."""
        years = int(self.months / 12)
        return years * 365.25 * 86_400 + (self.months - 12 * years) * 30 * 86_400 + self.days * 86_400 + self.micros / SECOND

    def __mul__(self, n: int) -> Interval:
        return Interval(self.months * n, self.days * n, self.micros * n)

    def fixed(self) -> bool:
        return self.months == 0

    def length(self) -> timedelta:
        """Length of an interval without months."""
        return timedelta(days=self.days, microseconds=self.micros)


def add(t: datetime, i: Interval, n: int = 1) -> datetime:
    """t + i * n; a month's end stays a month's end. OverflowError beyond year 9999."""
    months = t.year * 12 + t.month - 1 + i.months * n
    year, month = divmod(months, 12)
    if not 1 <= year <= 9999:
        raise OverflowError(f"{t} + {i} * {n} is out of range")
    day = min(t.day, monthrange(year, month + 1)[1])
    return t.replace(year=year, month=month + 1, day=day) + timedelta(days=i.days * n, microseconds=i.micros * n)


def age(a: datetime, b: datetime) -> Interval:
    """a - b in whole months, days and microseconds."""
    if a < b:
        return age(b, a) * -1
    months = (a.year - b.year) * 12 + a.month - b.month
    if add(b, Interval(months=months)) > a or (a.day, a.time()) < (b.day, b.time()) and (a.year, a.month) != (b.year, b.month):
        months -= 1 if add(b, Interval(months=months)) > a else 0
    rest = a - add(b, Interval(months=months))
    return Interval(months, rest.days, rest.seconds * SECOND + rest.microseconds)
