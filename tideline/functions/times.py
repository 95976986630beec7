"""Functions on times and numbers that expressions can call."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"Y": "YEAR", "M": "MONTH", "W": "WEEK", "D": "DAY", "h": "HOUR", "m": "MINUTE", "s": "SECOND"}
#: Prefixes from 10^-24 to 10^24.
PREFIXES = "yzafpnum_kMGTPEZY"


def truncated(t: Column, unit: str) -> Column:
    """As floor(), for a time without zone. From its date and clock, since date_trunc would pass through the session's zone and its clock changes."""
    day = t.cast("date")
    if unit in "YMW":
        return F.trunc(day, UNITS[unit]).cast("timestamp_ntz")
    clock = {"D": (), "h": ("hour",), "m": ("hour", "minute"), "s": ("hour", "minute", "second")}[unit]
    start = day.cast("timestamp_ntz")
    return start + F.make_dt_interval(hours=F.hour(t) if "hour" in clock else F.lit(0), mins=F.minute(t) if "minute" in clock else F.lit(0), secs=F.second(t).cast("decimal(18,6)") if "second" in clock else F.lit(0).cast("decimal(18,6)")) if clock else start


def elapsed(start: Column, stop: Column, unit: str = "1 second") -> Column:
    """Whole units from one time without zone to another, whatever the session's zone is; timestamp_diff would count its clock changes."""
    return F.call_function("div", stop.cast("timestamp_ntz") - start.cast("timestamp_ntz"), F.expr(f"interval '{unit.split()[0]}' {unit.split()[1]}"))


def since_1970(t: Column, unit: str = "1 second") -> Column:
    return elapsed(F.lit("1970-01-01 00:00:00"), t, unit)


def floor(c: Column, unit: str) -> Column:
    """The beginning of the year, month, week (Monday), day, hour, minute or second of a time."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    if not isinstance(c, Column):
        return c
    out = truncated(c.cast("timestamp_ntz"), unit)
    try:
        out._floor_of = (c, unit)  # lets a comparison with a constant become a range on the column itself
    except AttributeError:
        pass
    return out


def floor_range(op: str, a, b) -> Column | None:
    """(= (floor c unit) time) as c >= time and c < next, which a scan can use; None if it is no such comparison."""
    if op != "=" or not isinstance(b, str) or not hasattr(a, "_floor_of") or not isinstance(getattr(a, "_floor_of", None), tuple):
        return None
    c, unit = a._floor_of
    try:
        t = dt.datetime.fromisoformat(b if len(b) > 7 else b + ("-01-01" if len(b) == 4 else "-01"))
    except ValueError:
        return None
    step = {"W": dt.timedelta(7), "D": dt.timedelta(1), "h": dt.timedelta(hours=1), "m": dt.timedelta(minutes=1), "s": dt.timedelta(seconds=1)}
    end = t.replace(year=t.year + 1) if unit == "Y" else (t.replace(day=1) + dt.timedelta(32)).replace(day=1) if unit == "M" else t + step[unit]
    begins = {"Y": (t.month, t.day, t.hour, t.minute, t.second), "M": (t.day, t.hour, t.minute, t.second), "W": (t.weekday(), t.hour, t.minute, t.second), "D": (t.hour, t.minute, t.second), "h": (t.minute, t.second), "m": (t.second,), "s": (0,)}[unit]
    if t.microsecond or any(x != y for x, y in zip(begins, (1, 1, 0, 0, 0) if unit == "Y" else (1, 0, 0, 0) if unit == "M" else (0,) * 5)):
        return F.lit(False)
    lit = lambda x: F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")
    return (c >= lit(t)) & (c < lit(end))


def as_tz(c: Column, zone: str) -> Column:
    """Local time in a zone, without zone, of a time in UTC without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), c.cast("timestamp_ntz"))


def day_of_week_num(c: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(c)


def strpt(text):
    return dt.datetime.fromisoformat(text) if isinstance(text, str) else F.to_timestamp(text).cast("timestamp_ntz")


def two_digits(c: Column) -> Column:
    """Two decimals of the exact binary value, halves to even, as printf has it."""
    return F.replace(F.format_number(c, 2), F.lit(","))


def pretty_nb(c):
    """A number with two decimals and the prefix of its power of a thousand; 0 stays 0."""
    if not isinstance(c, Column):
        if c == 0:
            return "0"
        if c < 0:
            return "-" + pretty_nb(-c)
        i = max(-8, min(7, next(e for e in range(7, -10, -1) if c >= 1000.0**e or e == -9)))
        p = PREFIXES[i + 8]
        return f"{c / 1000.0**i:.2f}{'' if p == '_' else p}"
    size = F.abs(c.cast("double"))
    text = None
    for e in range(7, -9, -1):
        p = PREFIXES[e + 8]
        shown = F.concat(two_digits(size / F.lit(1000.0**e)), F.lit("" if p == "_" else p))
        text = F.when(size >= F.lit(1000.0**e), shown) if text is None else text.when(size >= F.lit(1000.0**e), shown)
    text = text.otherwise(F.concat(two_digits(size / F.lit(1000.0**-8)), F.lit("y")))
    return F.when(c == 0, "0").otherwise(F.concat(F.when(c < 0, "-").otherwise(""), text))


def hexdigest(c: Column) -> Column:
    return F.sha1(c)


def hextime(c: Column) -> Column:
    """Milliseconds since 1970 of a time as eleven hexadecimal digits."""
    ms = since_1970(c, "0.001 second")
    return F.lpad(F.lower(F.hex(ms)), 11, "0")


def hashed_path(c: Column, depth: int = 2) -> Column:
    """A digest as folders of two digits each and the rest."""
    parts = [F.substring(c, 2 * i + 1, 2) for i in range(depth)]
    return F.concat_ws("/", *parts, F.substring(c, F.lit(2 * depth + 1), F.length(c)))
