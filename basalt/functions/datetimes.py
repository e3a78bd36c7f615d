"""Dates and times: values with modifiers, strftime and differences.

A moment is a timestamp without zone.  Values are timestamps, ISO texts, Julian
days or Unix seconds; modifiers are constants and are compiled into expressions.
An unknown modifier or unreadable value gives null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _nothing() -> Column:
    return F.lit(None).cast("timestamp_ntz")


def _add_seconds(moment: Column, seconds: Column) -> Column:
    micros = F.unix_micros(moment.cast("timestamp")) + F.round(seconds.cast("double") * 1_000_000).cast("bigint")
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def from_text(x: Column) -> Column:
    """A moment from YYYY-MM-DD[ T]HH:MM[:SS[.SSS]][Z or ±HH:MM], HH:MM[:SS[.SSS]] (on 2000-01-01), or a Julian day."""
    x = F.trim(x)
    date = r"^(-?\d{4}-\d{2}-\d{2})"
    time = r"(\d{2}:\d{2}(:\d{2}(\.\d+)?)?)"
    zone = r"\s*(Z|z|[+-]\d{2}:\d{2})?$"
    full = x.rlike(date + r"([ T]+" + time + zone + ")?$")
    alone = x.rlike("^" + time + zone)
    day = F.when(full, F.regexp_extract(x, date, 1)).when(alone, F.lit("2000-01-01"))
    clock = F.regexp_extract(x, time, 1)
    clock = F.when(clock == "", F.lit("00:00:00")).when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock)
    stamp = F.concat(day, F.lit(" "), clock).try_cast("timestamp_ntz")
    sign = F.when(F.regexp_extract(x, zone, 1).startswith("-"), F.lit(1)).otherwise(F.lit(-1))
    offset = F.regexp_extract(x, r"\d[+-](\d{2}):(\d{2})$", 1).try_cast("int") * 3600 + F.regexp_extract(x, r"\d[+-](\d{2}):(\d{2})$", 2).try_cast("int") * 60
    zoned = F.when(clock.isNotNull() & offset.isNotNull() & x.rlike(":"), _add_seconds(stamp, sign * offset)).otherwise(stamp)
    return F.when(full | alone, zoned).when(x.rlike(r"^\d+(\.\d+)?$"), from_julian(x.try_cast("double")))


def from_julian(x: Column) -> Column:
    return F.timestamp_micros(F.round((x - 2440587.5) * 86_400_000).cast("bigint") * 1000).cast("timestamp_ntz")


def from_unix(x: Column) -> Column:
    return F.timestamp_micros(F.round(x * 1_000_000).cast("bigint")).cast("timestamp_ntz")


def _rolled(moment: Column, months: int, floor: bool) -> Column:
    """Months added; a day beyond the month's end rolls into the next month, or stops there with floor."""
    first = F.trunc(moment, "MM")
    target = F.add_months(first, months)
    days = F.dayofmonth(moment) - 1
    if floor:
        days = F.least(days, F.dayofmonth(F.last_day(target)) - 1)
    date = F.date_add(target, days)
    clock = F.unix_micros(moment.cast("timestamp")) - F.unix_micros(F.date_trunc("day", moment).cast("timestamp"))
    return F.timestamp_micros(F.unix_micros(date.cast("timestamp")) + clock).cast("timestamp_ntz")


def moment(value: Column, *modifiers: str, kind: str = "timestamp") -> Column:
    """The moment of a value (kind: timestamp, text or number) after its modifiers, from left to right."""
    rest = [m.strip().lower() for m in modifiers]
    if kind == "number":
        if rest[:1] == ["unixepoch"]:
            out, rest = from_unix(value.cast("double")), rest[1:]
        elif rest[:1] == ["auto"]:
            julian = (value >= 0) & (value < 5373484.5)
            out, rest = F.when(julian, from_julian(value.cast("double"))).otherwise(from_unix(value.cast("double"))), rest[1:]
        else:
            out, rest = from_julian(value.cast("double")), rest[1:] if rest[:1] == ["julianday"] else rest
    elif kind == "text":
        out = from_text(value)
    else:
        out = value.cast("timestamp_ntz")
    for k, m in enumerate(rest):
        floor = rest[k + 1 : k + 2] == ["floor"]
        if m in ("utc", "localtime", "subsec", "subsecond", "floor", "ceiling", "auto"):
            continue
        if m in ("start of day", "start of month", "start of year"):
            out = F.date_trunc(m.rsplit(" ", 1)[1], out).cast("timestamp_ntz")
            continue
        if found := re.fullmatch(r"weekday ([0-6])", m):
            ahead = F.pmod(F.lit(int(found[1]) + 8) - F.dayofweek(out), F.lit(7))
            out = _add_seconds(out, ahead * 86400)
            continue
        if found := re.fullmatch(r"([+-]?\d+(?:\.\d+)?) (second|minute|hour|day|month|year)s?", m):
            n, unit = float(found[1]), found[2]
            if unit in UNITS:
                out = _add_seconds(out, F.lit(n * UNITS[unit]))
            else:
                whole = int(n)
                out = _rolled(out, whole * (12 if unit == "year" else 1), floor)
                if n != whole:
                    out = _add_seconds(out, F.lit((n - whole) * (365 if unit == "year" else 30) * 86400))
            continue
        if found := re.fullmatch(r"([+-])(\d{4})-(\d{2})-(\d{2})(?: (\d{2}):(\d{2})(?::(\d{2}))?)?", m):
            s = -1 if found[1] == "-" else 1
            out = _rolled(out, s * (int(found[2]) * 12 + int(found[3])), floor)
            seconds = int(found[4]) * 86400 + int(found[5] or 0) * 3600 + int(found[6] or 0) * 60 + int(found[7] or 0)
            out = _add_seconds(out, F.lit(s * seconds))
            continue
        if found := re.fullmatch(r"([+-])(\d{2}):(\d{2})(?::(\d{2}))?", m):
            s = -1 if found[1] == "-" else 1
            out = _add_seconds(out, F.lit(s * (int(found[2]) * 3600 + int(found[3]) * 60 + int(found[4] or 0))))
            continue
        return _nothing()
    return out


def date(value: Column, *modifiers: str, kind: str = "timestamp") -> Column:
    return F.date_format(moment(value, *modifiers, kind=kind), "yyyy-MM-dd")


def time(value: Column, *modifiers: str, kind: str = "timestamp") -> Column:
    pattern = "HH:mm:ss.SSS" if {"subsec", "subsecond"} & set(modifiers) else "HH:mm:ss"
    return F.date_format(moment(value, *modifiers, kind=kind), pattern)


def datetime(value: Column, *modifiers: str, kind: str = "timestamp") -> Column:
    pattern = "yyyy-MM-dd HH:mm:ss.SSS" if {"subsec", "subsecond"} & set(modifiers) else "yyyy-MM-dd HH:mm:ss"
    return F.date_format(moment(value, *modifiers, kind=kind), pattern)


def julianday(value: Column, *modifiers: str, kind: str = "timestamp") -> Column:
    return F.floor(F.unix_micros(moment(value, *modifiers, kind=kind).cast("timestamp")) / 1000) / 86_400_000 + 2440587.5


def unixepoch(value: Column, *modifiers: str, kind: str = "timestamp") -> Column:
    micros = F.unix_micros(moment(value, *modifiers, kind=kind).cast("timestamp"))
    if {"subsec", "subsecond"} & set(modifiers):
        return F.floor(micros / 1000) / 1000
    return F.floor(micros / 1_000_000).cast("bigint")


def strftime(template: str, value: Column, *modifiers: str, kind: str = "timestamp") -> Column:
    """A moment by a template of % letters; an unknown letter gives null."""
    m = moment(value, *modifiers, kind=kind)
    fmt = lambda p: F.date_format(m, p)
    number = lambda x, n: F.lpad(x.cast("string"), n, "0")
    yday, sunday, monday = F.dayofyear(m), F.dayofweek(m) - 1, F.weekday(m)
    hour12 = F.pmod(F.hour(m) + 11, F.lit(12)) + 1
    known = {
        "d": fmt("dd"), "e": F.lpad(F.dayofmonth(m).cast("string"), 2, " "), "f": fmt("ss.SSS"), "F": fmt("yyyy-MM-dd"), "H": fmt("HH"),
        "I": number(hour12, 2), "j": number(yday, 3), "J": julianday(m).cast("string"), "k": F.lpad(F.hour(m).cast("string"), 2, " "),
        "l": F.lpad(hour12.cast("string"), 2, " "), "m": fmt("MM"), "M": fmt("mm"), "p": F.when(F.hour(m) < 12, "AM").otherwise("PM"),
        "P": F.when(F.hour(m) < 12, "am").otherwise("pm"), "R": fmt("HH:mm"), "s": unixepoch(m).cast("string"), "S": fmt("ss"), "T": fmt("HH:mm:ss"),
        "u": (monday + 1).cast("string"), "w": sunday.cast("string"), "U": number(F.floor((yday + 6 - sunday) / 7), 2), "W": number(F.floor((yday + 6 - monday) / 7), 2),
        "V": number(F.weekofyear(m), 2), "G": number(F.extract(F.lit("YEAROFWEEK"), m), 4), "g": number(F.extract(F.lit("YEAROFWEEK"), m) % 100, 2),
        "Y": fmt("yyyy"), "%": F.lit("%"),
    }
    parts, at = [], 0
    for found in re.finditer(r"%(.?)", template):
        if found.start() > at:
            parts.append(F.lit(template[at : found.start()]))
        if found[1] not in known:
            return F.lit(None).cast("string")
        parts.append(known[found[1]])
        at = found.end()
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts) if parts else F.when(m.isNotNull(), F.lit(""))


def timediff(a: Column, b: Column) -> Column:
    """What has to be added to b to get a, as ±YYYY-MM-DD HH:MM:SS.SSS."""
    a, b = a.cast("timestamp_ntz"), b.cast("timestamp_ntz")
    sign = F.when(a >= b, F.lit("+")).otherwise(F.lit("-"))
    late, early = F.greatest(a, b), F.least(a, b)
    day = lambda x: F.unix_micros(x.cast("timestamp"))
    months = (F.year(late) - F.year(early)) * 12 + F.month(late) - F.month(early)

    def shifted(n: Column) -> Column:
        date = F.date_add(F.add_months(F.trunc(early, "MM"), n), F.dayofmonth(early) - 1)
        return day(date) + day(early) - day(F.date_trunc("day", early))

    months = F.when(shifted(months) > day(late), months - 1).otherwise(months)
    left = F.floor((day(late) - shifted(months)) / 1000)
    pad = lambda x, n: F.lpad(x.cast("bigint").cast("string"), n, "0")
    clock = F.concat(pad(F.floor(left / 3_600_000) % 24, 2), F.lit(":"), pad(F.floor(left / 60_000) % 60, 2), F.lit(":"), pad(F.floor(left / 1000) % 60, 2), F.lit("."), pad(left % 1000, 3))
    return F.concat(sign, pad(F.floor(months / 12), 4), F.lit("-"), pad(months % 12, 2), F.lit("-"), pad(F.floor(left / 86_400_000), 2), F.lit(" "), clock)
