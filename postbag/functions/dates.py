"""Date helpers as columns.  The session time zone decides what a day is."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stand-in for a date that could not be read.
INVALID = "1960-01-01"


def is_valid(c: Column) -> Column:
    return c.isNotNull() & (F.to_date(c) != F.to_date(F.lit(INVALID)))


def within(c: Column, start: str | None = None, end: str | None = None) -> Column:
    """Days from start to end, both included; a missing or malformed bound is open."""

    def day(text: str | None) -> date | None:
        try:
            return date.fromisoformat(text) if text else None
        except ValueError:
            return None

    low, high = day(start), day(end)
    out = F.lit(True)
    if low:
        out = out & (c >= F.lit(low.isoformat()).cast("timestamp"))
    if high:
        out = out & (c < F.lit((high + timedelta(days=1)).isoformat()).cast("timestamp"))
    return out


def month(c: Column) -> Column:
    return F.date_trunc("month", c)


def months_apart(a: Column, b: Column) -> Column:
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def quarter_start(c: Column) -> Column:
    return F.date_trunc("quarter", c)


def day_parts(c: Column, year: int | None = None, month_: int | None = None, day: int | None = None) -> Column:
    """Equality on the parts that are given."""
    out = F.lit(True)
    for part, f in ((year, F.year), (month_, F.month), (day, F.dayofmonth)):
        if part is not None:
            out = out & (f(c) == part)
    return out


def span(year: int | None = None, month_: int | None = None, day: int | None = None) -> tuple[date, date]:
    """First and last day of a date of which parts may be missing; days past the month's end are its last."""
    if year is None:
        return date.min, date.max
    last_day = lambda m: (date(year + m // 12, m % 12 + 1, 1) - timedelta(days=1)).day
    if month_ is None:
        return date(year, 1, 1), date(year, 12, 31)
    if day is None:
        return date(year, month_, 1), date(year, month_, last_day(month_))
    d = min(day, last_day(month_))
    return date(year, month_, d), date(year, month_, d)


def parse(c: Column) -> Column:
    """A timestamp from the usual written forms, a weekday before it ignored; null if none fits."""
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "d MMM yyyy", "MMM d, yyyy", "d MMM yyyy HH:mm:ss Z")
    bare = F.regexp_replace(c, r"^\s*[A-Za-z]{3}, ", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in forms])


def display_month(c: Column) -> Column:
    return F.date_format(c, "MMM")


# Month names of loose date specifications.
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def loose(c: Column, spec: str) -> Column:
    """A loose specification such as `jul 4`, `aug-sep`, `2001` or `jun 2001 - feb 2002`;
    parts that are not given match anything."""

    def parts(text: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for w in text.lower().replace(",", " ").split():
            if w[:3] in _MONTHS:
                out["m"] = _MONTHS.index(w[:3]) + 1
            elif w.isdigit():
                out["y" if len(w) == 4 else "d"] = int(w)
            else:
                raise ValueError(f"cannot read date part {w!r}")
        return out

    ends = [parts(p) for p in spec.split("-")]
    if len(ends) == 1:
        p = ends[0]
        return day_parts(c, p.get("y"), p.get("m"), p.get("d"))
    low, high = ends
    if "y" not in low and "y" in high:
        low["y"] = high["y"]
    names = [k for k in "ymd" if k in low or k in high]
    weights = {"y": 10_000, "m": 100, "d": 1}
    defaults = ({"y": 0, "m": 1, "d": 1}, {"y": 9999, "m": 12, "d": 31})
    columns = {"y": F.year(c), "m": F.month(c), "d": F.dayofmonth(c)}
    value = sum((columns[k] * weights[k] for k in names), F.lit(0))
    first, last = (sum(p.get(k, d[k]) * weights[k] for k in names) for p, d in zip((low, high), defaults, strict=True))
    if first <= last:
        return value.between(first, last)
    return (value >= first) | (value <= last)  # a range over the turn of the year
