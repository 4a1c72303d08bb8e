"""Sizes and dates of the query language. Everything is resolved here, on the driver, from an injected `now`."""

from __future__ import annotations

import datetime as dt
import re

DAY = 86_400
# The units, and the named sizes with how they compare.
UNITS = {"kb": 1, "mb": 2, "gb": 3, "kib": 1, "mib": 2, "gib": 3}
NAMED_SIZES = {"tiny": ("<", 1, 1), "small": ("<", 1, 2), "medium": ("<", 1, 3), "large": (">", 1, 3), "huge": (">", 4, 3), "gigantic": (">", 16, 3)}
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "sunday monday tuesday wednesday thursday friday saturday".split()
SECONDS = {"days": DAY, "weeks": 7 * DAY, "months": 31 * DAY, "years": 365 * DAY, "hours": 3600, "minutes": 60, "mins": 60, "seconds": 1, "secs": 1}
LARGEST = 2**63 - 1


def size_value(text: str, metric: bool = False) -> tuple[int, int] | None:
    """(bytes, unit) of `10mb`, `1.5 kib`, `7`; None if it is none."""
    m = re.fullmatch(r"\s*\+?(\d+\.?\d*|\.\d+)\s*(kb|mb|gb|kib|mib|gib|b)?\s*", text.lower(), re.ASCII)
    if not m:
        return None
    unit = m[2] or "b"
    factor = 1 if unit == "b" else (1000 if metric and "i" not in unit else 1024) ** UNITS[unit]
    return min(int(float(m[1]) * factor), LARGEST), factor


def size_bounds(text: str, metric: bool = False) -> tuple[int | None, int | None] | None:
    """Inclusive (low, high) of a size term's value, None for open ends; None if it is malformed."""
    text = text.strip()
    low = text.lower()
    if low == "empty":
        return 0, 0
    if low in NAMED_SIZES:
        sign, n, power = NAMED_SIZES[low]
        v = n * (1000 if metric else 1024) ** power
        return (None, v - 1) if sign == "<" else (v + 1, None)
    if ".." in text:
        a, b = (size_value(x, metric) for x in text.split("..", 1))
        return (a[0], b[0]) if a and b else None
    sign = re.match(r">=|<=|>|<|=|", text)[0]
    v = size_value(text[len(sign) :], metric)
    if v is None:
        return None
    n, unit = v
    if sign:
        return {">=": (n, None), "<=": (None, n), ">": (n + 1, None), "<": (None, n - 1), "=": (n, n)}[sign]
    return (n, n + unit - 1) if unit > 1 else (n, n)


def day_start(t: int) -> int:
    return t - t % DAY


def _unix(year: int, month: int, day: int = 1) -> int:
    year, month = year + (month - 1) // 12, (month - 1) % 12 + 1
    return (dt.date(year, month, day) - dt.date(1970, 1, 1)).days * DAY


def date_value(text: str, now: int) -> int | None:
    """Local midnight of today, yesterday, Ndays ago, or an ISO date (a time of day is not looked at); None if it is none."""
    text = text.strip().lower()
    if text in ("today", "yesterday"):
        return day_start(now) - DAY * (text == "yesterday")
    if m := re.fullmatch(r"(\d+)\s*days", text):
        return day_start(now - int(m[1]) * DAY)
    m = re.match(r"(\d{4})-(\d{2})-(\d{2})(?=$|[t ])", text)
    try:
        day = dt.date(int(m[1]), int(m[2]), int(m[3])) if m else dt.date.min
        return (day - dt.date(1970, 1, 1)).days * DAY if day.year >= 1970 else None
    except ValueError:
        return None


def span(text: str, now: int) -> tuple[int, int] | None:
    """[start, end) of a named or relative span of local wall seconds."""
    text, today = text.strip().lower(), day_start(now)
    if m := re.fullmatch(r"(last|past|previous|prev|)\s*(\d+)\s*([a-z]+)", text):
        length = SECONDS.get(m[3], 0) * int(m[2])
        if not length:
            return None
        if m[1].startswith("prev"):
            return today - length, today
        return now - length, now + (DAY if SECONDS[m[3]] >= DAY else 0)
    y, month = (d := dt.date(1970, 1, 1) + dt.timedelta(days=today // DAY)).year, d.month
    week = today - d.isoweekday() % 7 * DAY
    starts = {"week": (week - 7 * DAY, week), "month": (_unix(y, month - 1), _unix(y, month)), "year": (_unix(y - 1, 1), _unix(y, 1))}
    if m := re.fullmatch(r"(this|last|past|previous|prev)(week|month|year)", text):
        before, this = starts[m[2]]
        if m[1] == "this":
            return this, now + DAY
        return (before, this) if m[1].startswith("prev") else (now - SECONDS[m[2] + "s"], now + DAY)
    to_date = {"mtd": starts["month"][1], "ytd": starts["year"][1], "qtd": _unix(y, (month - 1) // 3 * 3 + 1)}
    if text in to_date:
        return to_date[text], now
    for k, name in enumerate(MONTHS, 1):
        if text in (name, name[:3]):
            return _unix(y, k), _unix(y, k + 1)
    for k, name in enumerate(WEEKDAYS):
        if text in (name, name[:3]):
            return week + k * DAY, week + (k + 1) * DAY
    return None


def date_bounds(text: str, now: int) -> tuple[int | None, int | None] | None:
    """[start, end) of a date term's value, None for open ends; None if it is malformed."""
    text = text.strip()
    if text[:1] in (">", "<"):
        d = date_value(text[1:], now)
        return None if d is None else (d + DAY, None) if text[0] == ">" else (None, d)
    if ".." in text:
        a, b = (date_value(x, now) for x in text.split("..", 1))
        return None if a is None or b is None else (a, b)
    if found := span(text, now):
        return found
    d = date_value(text, now)
    return None if d is None else (d, d + DAY)
