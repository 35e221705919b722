"""Durations, labels and calendars on the driver."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Sequence
from collections.abc import Set as AbstractSet

from quantloom.errors import FactorError

#: Microseconds by unit.
UNITS = {"d": 86_400_000_000, "h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1_000, "us": 1, "ns": 0}
_PART = re.compile(r"([0-9]+)(ms|us|ns|[dhms])", re.IGNORECASE)


def duration_micros(label: str) -> int:
    """Microseconds of labels such as '5D' or '1D3h'; nanoseconds count 0."""
    if not label or not re.fullmatch(rf"(?:{_PART.pattern})+", label, re.IGNORECASE):
        raise FactorError(f"not a duration: {label}")
    return sum(int(n) * UNITS[u.lower()] for n, u in _PART.findall(label))


def timedelta_to_string(delta: dt.timedelta) -> str:
    """'1D3h30m' and so on; units that are zero are left out."""
    rest, out = delta // dt.timedelta(microseconds=1), ""
    for unit, name in (("d", "D"), ("h", "h"), ("m", "m"), ("s", "s"), ("ms", "ms"), ("us", "us")):
        n, rest = divmod(rest, UNITS[unit])
        out += f"{n}{name}" if n else ""
    return out


def timedelta_strings_to_integers(labels: Iterable[str]) -> list[int]:
    """Whole days of each label."""
    return [duration_micros(x) // UNITS["d"] for x in labels]


def get_forward_returns_columns(columns: Iterable[str], require_exact_day_multiple: bool = False) -> list[str]:
    """The names whose label, prefixed or not, is a duration; only whole days if asked."""
    out = []
    for c in columns:
        try:
            n = duration_micros(c.removeprefix("forward_return_"))
        except FactorError:
            continue
        if not require_exact_day_multiple or n % UNITS["d"] == 0:
            out.append(c)
    return out


def session_label(times: Sequence[int], period: int) -> str:
    """The span of the first `period` sessions of an intraday calendar (microseconds, ascending)."""
    if period >= len(times):
        return f"{period}D"
    start, end, day = times[0], times[period], UNITS["d"]
    span = end - start
    if span >= day and start % day == end % day:
        same = sum(1 for t in times if start < t <= end and t % day == start % day)
        return f"{same or period}D"
    for name, unit in (("D", day), ("h", UNITS["h"]), ("m", UNITS["m"]), ("s", UNITS["s"])):
        if span % unit == 0:
            return f"{span // unit}{name}"
    return f"{span // UNITS['ms']}ms"


#: Days of the week that are sessions: seven flags from Monday, or the numbers of those days.
Weekmask = Sequence[bool] | AbstractSet[int]
_WORKDAYS = (True,) * 5 + (False,) * 2


def _open_days(weekmask: Weekmask | None) -> frozenset[int]:
    """The numbers of the days that are sessions, Monday 0; no or an empty mask is Monday to Friday, seven flags without a session or anything else are an error."""
    weekmask = weekmask or _WORKDAYS
    days = frozenset(weekmask) if isinstance(weekmask, AbstractSet) else frozenset(i for i, x in enumerate(weekmask) if x) if len(weekmask) == 7 else frozenset()
    if not days or not all(isinstance(d, int) and 0 <= d <= 6 for d in days):
        raise FactorError("a weekmask has seven flags, or numbers of days from 0 to 6, and one session at least")
    return days


def add_custom_calendar_timedelta(value: dt.datetime, delta: dt.timedelta, holidays: Iterable[dt.date] | None = None, weekmask: Weekmask | None = None) -> dt.datetime:
    """value plus the delta's days counted in sessions, plus the rest of it."""
    closed, days, step = frozenset(holidays or ()), _open_days(weekmask), 1 if delta.days >= 0 else -1
    left, out = abs(delta.days), value
    while left:
        out += dt.timedelta(days=step)
        left -= out.weekday() in days and out.date() not in closed
    return out + (delta - dt.timedelta(days=delta.days))


def diff_custom_calendar_timedeltas(start: dt.datetime, end: dt.datetime, holidays: Iterable[dt.date] | None = None, weekmask: Weekmask | None = None) -> dt.timedelta:
    """Sessions reached from start at its time of day, as days, and what is left from the last of them to end; negated for reversed ends."""
    closed, days, day = frozenset(holidays or ()), _open_days(weekmask), dt.timedelta(days=1)
    if end < start:
        return -diff_custom_calendar_timedeltas(end, start, closed, weekmask)
    every = (start + i * day for i in range(1, (end - start) // day + 1))
    reached = [d for d in every if d.weekday() in days and d.date() not in closed]
    return len(reached) * day + (end - (reached[-1] if reached else start))


def infer_trading_calendar(factor_dates: Iterable[dt.datetime], price_dates: Iterable[dt.datetime]) -> dict[str, set]:
    """weekmask: the numbers of the weekdays that occur at all; holidays: missing days of those weekdays."""
    seen = {d.date() for d in [*factor_dates, *price_dates]}
    mask = {d.weekday() for d in seen}
    first, last = (min(seen), max(seen)) if seen else (dt.date.min, dt.date.min)
    between = (first + dt.timedelta(days=i) for i in range((last - first).days))
    return {"weekmask": mask, "holidays": {d for d in between if d.weekday() in mask and d not in seen}}
