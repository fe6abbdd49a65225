"""Dates, local date-times and durations.

A duration is a struct of months, days, seconds and nanoseconds, none of which
is exchanged for another.  Instants have microseconds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CypherTypeError
from .values import DURATION, LOCALTIME, NULL, TIME, ZONED, E, float_text, kind_of, make_map

_UNITS = {"years": (12, 0, 0), "quarters": (3, 0, 0), "months": (1, 0, 0), "weeks": (0, 7, 0), "days": (0, 1, 0), "hours": (0, 0, 3600), "minutes": (0, 0, 60), "seconds": (0, 0, 1), "milliseconds": (0, 0, 1e-3), "microseconds": (0, 0, 1e-6), "nanoseconds": (0, 0, 1e-9)}
#: As whole numbers: months, days, seconds, nanoseconds.
_WHOLE = {n: (m, d, int(x), 0) if x == int(x) else (0, 0, 0, round(x * 1e9)) for n, (m, d, x) in _UNITS.items()}
MONTH_DAYS = 30.436875


def _long(c: Column) -> Column:
    return c.cast("long")


def make_duration(months: Column, days: Column, seconds: Column) -> E:
    """From possibly fractional parts; fractions go down to the next unit."""
    trunc = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))
    m = trunc(months)
    d_all = days + (months - m) * MONTH_DAYS
    d = trunc(d_all)
    s_all = seconds + (d_all - d) * 86400
    s = F.floor(s_all)
    return E(F.struct(_long(m).alias("months"), _long(d).alias("days"), _long(s).alias("seconds"), _long(F.round((s_all - s) * 1e9)).alias("nanos")), DURATION, "duration")


def duration(arg: E) -> E:
    if arg.family == "null":
        return NULL
    total, whole = [F.lit(0.0), F.lit(0.0), F.lit(0.0)], [F.lit(0).cast("long")] * 4
    if arg.kind == "map":
        fractions = False
        for f in arg.t:
            if f.name not in _UNITS:
                raise CypherTypeError(f"a duration has no {f.name}")
            exact = isinstance(f.dataType, (T.LongType, T.IntegerType))
            fractions |= not exact
            sums, units = (whole, _WHOLE) if exact else (total, _UNITS)
            for i, k in enumerate(units[f.name]):
                if k:
                    sums[i] = sums[i] + arg.col[f.name].cast("long" if exact else "double") * k
        return _with_whole(make_duration(*total) if fractions else None, *whole)
    if arg.family != "string":
        raise CypherTypeError("duration() takes a map or a string")
    part = lambda p: F.coalesce(F.nullif(F.regexp_extract(arg.col, p, 1), F.lit("")).cast("double"), F.lit(0.0))
    n = r"(-?\d+(?:\.\d+)?)"
    date_part, time_part = r"^P[^T]*?", r"T.*?"
    months = part(date_part + n + "Y") * 12 + part(date_part + n + "M")
    days = part(date_part + n + "W") * 7 + part(date_part + n + "D")
    seconds = part(time_part + n + "H") * 3600 + part(time_part + n + "M") * 60
    # seconds as a decimal: all nine places count
    exact = F.coalesce(F.nullif(F.regexp_extract(arg.col, time_part + n + "S", 1), F.lit("")).cast("decimal(28,9)"), F.lit(0).cast("decimal(28,9)"))
    combined = r"^P(\d{4})-(\d{2})-(\d{2})(?:T(\d{2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?)?$"
    alike = F.regexp_extract(arg.col, combined, 1) != ""
    num = lambda g: F.coalesce(F.nullif(F.regexp_extract(arg.col, combined, g), F.lit("")).cast("double"), F.lit(0.0))
    either = lambda a, b: F.when(alike, a).otherwise(b)
    zero, base = F.lit(0).cast("long"), F.floor(exact)
    rest = make_duration(either(num(1) * 12 + num(2), months), either(num(3), days), either(num(4) * 3600 + num(5) * 60 + num(6), seconds))
    return _with_whole(rest, zero, zero, _long(base), _long((exact - base) * 1000000000))


def _with_whole(e: E | None, months: Column, days: Column, seconds: Column, nanos: Column) -> E:
    """A duration (none: zero) and whole parts that no double has touched; nanoseconds from 0 below a second."""
    if e is None:
        e = E(F.struct(*[F.lit(0).cast("long").alias(n) for n in DURATION.names]), DURATION, "duration")

    def summed(x: Column) -> Column:
        n = x["e"]["nanos"] + x["n"]
        up = _long(F.floor(n / F.lit(1000000000).cast("decimal(20,0)")))
        return F.struct((x["e"]["months"] + x["m"]).alias("months"), (x["e"]["days"] + x["d"]).alias("days"), (x["e"]["seconds"] + x["s"] + up).alias("seconds"), (n - up * 1000000000).alias("nanos"))

    return E(let(F.struct(e.col.alias("e"), months.alias("m"), days.alias("d"), seconds.alias("s"), nanos.alias("n")), summed), DURATION, "duration")


def date(arg: E) -> E:
    if arg.family == "null":
        return NULL
    if arg.family in ("date", "localdatetime", "datetime", "zoned"):
        return E(local_of(arg).cast("date"), T.DateType())
    if arg.family == "string":
        s = arg.col
        week = F.regexp_extract(s, r"^(\d{4})-?W(\d{2})(?:-?(\d))?$", 1)
        w = lambda g: F.regexp_extract(s, r"^(\d{4})-?W(\d{2})(?:-?(\d))?$", g)
        o = lambda g: F.regexp_extract(s, r"^(\d{4})-?(\d{3})$", g)
        y = lambda g: F.regexp_extract(s, r"^(\d{4})(?:-?(\d{2})(?:-?(\d{2}))?)?$", g)
        num = lambda c, default: F.coalesce(F.nullif(c, F.lit("")).cast("int"), F.lit(default))
        out = (
            F.when(week != "", week_date(num(w(1), 1), num(w(2), 1), num(w(3), 1)))
            .when(o(1) != "", F.date_add(F.make_date(num(o(1), 1), F.lit(1), F.lit(1)), num(o(2), 1) - 1))
            .when(y(1) != "", F.make_date(num(y(1), 1), num(y(2), 1), num(y(3), 1)))
            .otherwise(s.cast("date"))
        )
        return E(out, T.DateType())
    if arg.kind == "map":
        return E(_date_of(arg), T.DateType())
    raise CypherTypeError("date() takes a map, a string or a temporal value")


def week_date(year: Column, week: Column, day: Column) -> Column:
    fourth = F.make_date(year, F.lit(1), F.lit(4))  # is in week 1
    return F.date_add(F.date_sub(fourth, F.weekday(fourth)), (week - 1) * 7 + day - 1)


def _date_of(arg: E) -> Column:
    names = set(arg.t.names)
    base = E(arg.col["date"], arg.t["date"].dataType, kind_of(arg.t["date"].dataType)) if "date" in names else None
    day = date(base).col if base else None
    get = lambda n, default: arg.col[n].cast("int") if n in names else default
    if not names & {"year", "date"}:
        raise CypherTypeError("a date needs a year")
    if "week" in names:
        y = get("year", F.date_part(F.lit("YEAROFWEEK"), day).cast("int") if base else None)
        return week_date(y, get("week", None), get("dayOfWeek", F.weekday(day) + 1 if base else F.lit(1)))
    if base and "dayOfWeek" in names:
        return F.date_add(day, arg.col["dayOfWeek"].cast("int") - 1 - F.weekday(day))
    y = get("year", F.year(day) if base else None)
    if "ordinalDay" in names:
        return F.date_add(F.make_date(y, F.lit(1), F.lit(1)), get("ordinalDay", None) - 1)
    if "quarter" in names or base and "dayOfQuarter" in names:
        first = F.make_date(y, get("quarter", F.quarter(day) if base else None) * 3 - 2, F.lit(1))
        if "dayOfQuarter" in names:
            return F.date_add(first, get("dayOfQuarter", None) - 1)
        return first
    return F.make_date(y, get("month", F.month(day) if base else F.lit(1)), get("day", F.dayofmonth(day) if base else F.lit(1)))


DAY = 86_400_000_000_000


def let(value: Column, body) -> Column:
    """body(value) with value as one computed thing, so that expressions don't multiply."""
    return F.transform(F.array(value), body)[0]


def once(e: E, f) -> E:
    """f(e) with e computed once."""
    made: list[E] = []

    def body(v: Column) -> Column:
        made.append(f(E(v, e.t, e.kind)))
        return made[-1].col

    col = let(e.col, body)
    return E(col, made[-1].t, made[-1].kind)


def clock(s: Column) -> Column:
    """Nanoseconds of the day from HH[:MM[:SS[.fraction]]], with or without colons; null if it is none of these."""
    pattern = r"^(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?)?$"
    part = lambda g: F.regexp_extract(s, pattern, g)
    num = lambda c: F.coalesce(F.nullif(c, F.lit("")).cast("long"), F.lit(0).cast("long"))
    nanos = F.coalesce(F.nullif(F.rpad(part(4), 9, "0"), F.lit("000000000")).try_cast("long"), F.lit(0).cast("long"))
    return F.when(part(1) != "", (num(part(1)) * 3600 + num(part(2)) * 60 + num(part(3))) * 1000000000 + F.when(part(4) == "", F.lit(0).cast("long")).otherwise(nanos))


def offset_of(s: Column) -> Column:
    """Seconds from Z, +HH, +HHMM or +HH:MM; null if it is none of these."""
    part = lambda g: F.regexp_extract(s, r"^([+-])(\d{2})(?::?(\d{2}))?$", g)
    size = part(2).try_cast("int") * 3600 + F.coalesce(F.nullif(part(3), F.lit("")).try_cast("int"), F.lit(0)) * 60
    return F.when(s.isin("Z", "z"), F.lit(0)).when(part(1) != "", F.when(part(1) == "-", -size).otherwise(size))


def _split_zone(s: Column) -> tuple[Column, Column, Column]:
    """The local part, the offset and the zone of a text."""
    part = lambda g: F.regexp_extract(s, r"^(.*?)(Z|[+-]\d{2}(?::?\d{2})?)?(?:\[(.+)\])?$", g)
    return part(1), F.nullif(part(2), F.lit("")), F.nullif(part(3), F.lit(""))


def _nanos_of(arg: E) -> Column:
    """Nanoseconds of the day of a map's hour to nanosecond, over its time or datetime if it has one."""
    names = arg.t.names
    base = next((E(arg.col[n], arg.t[n].dataType, kind_of(arg.t[n].dataType)) for n in ("time", "datetime") if n in names), None)
    of = (lambda n: component(base, n).col) if base else (lambda n: F.lit(0).cast("long"))
    get = lambda n: arg.col[n].cast("long") if n in names else None
    whole = [get(n) if n in names else of(n) for n in ("hour", "minute", "second")]
    parts = [get(n) for n in ("millisecond", "microsecond", "nanosecond")]
    if any(p is not None for p in parts):
        fraction = F.lit(0).cast("long")
        for p, k in zip(parts, (1000000, 1000, 1), strict=True):
            if p is not None:
                fraction = fraction + p * k
    else:
        fraction = of("nanosecond")
    return (whole[0] * 3600 + whole[1] * 60 + whole[2]) * 1000000000 + fraction


def local_nanos(e: E) -> Column:
    """Nanoseconds of the day of anything with a time."""
    if e.family == "localtime":
        return e.col["localtime_nanos"]
    if e.family == "time":
        return e.col["time_nanos"]
    ts = local_of(e)
    return F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(86400000000)) * 1000


def local_of(e: E) -> Column:
    """The local date-time of a date, a local date-time or a zoned one."""
    if e.family == "zoned":
        return e.col["utc"] + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), e.col["utc_offset"].cast("decimal(18,6)"))
    return e.col.cast("timestamp_ntz")


def at_clock(day: Column, nanos: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.call_function("div", nanos, F.lit(1000)) / F.lit(1000000)).cast("decimal(18,6)"))


def localtime(arg: E) -> E:
    if arg.family == "string":
        nanos = clock(F.regexp_replace(_split_zone(arg.col)[0], "^.*T", ""))
    elif arg.kind == "map":
        nanos = _nanos_of(arg)
    else:
        nanos = local_nanos(arg)
    return E(F.when(nanos.isNotNull(), F.struct(_long(nanos).alias("localtime_nanos"))), LOCALTIME, "localtime")


def time(arg: E) -> E:
    if arg.family == "string":
        local, offset, _ = _split_zone(F.regexp_replace(arg.col, "^.*T", ""))
        nanos, seconds = clock(local), F.coalesce(offset_of(offset), F.lit(0))
    elif arg.kind == "map":
        nanos, old = _nanos_of(arg), None
        if "time" in arg.t.names:
            base = E(arg.col["time"], arg.t["time"].dataType, kind_of(arg.t["time"].dataType))
            old = base.col["time_offset"] if base.family == "time" else base.col["utc_offset"] if base.family == "zoned" else None
        seconds = offset_of(arg.col["timezone"]) if "timezone" in arg.t.names else F.lit(0) if old is None else old
        if old is not None and "timezone" in arg.t.names:  # the same instant in another zone
            nanos = F.pmod(nanos + (seconds - old).cast("long") * 1000000000, F.lit(DAY))
    else:
        nanos = local_nanos(arg)
        seconds = arg.col["time_offset"] if arg.family == "time" else arg.col["utc_offset"] if arg.family == "zoned" else F.lit(0)
    return E(F.when(nanos.isNotNull(), F.struct(_long(nanos).alias("time_nanos"), seconds.cast("int").alias("time_offset"))), TIME, "time")


def localdatetime(arg: E) -> E:
    t = T.TimestampNTZType()
    if arg.kind == "map":
        names = arg.t.names
        if "datetime" in names and not {"year", "date"} & set(names):
            inner = E(arg.col["datetime"], arg.t["datetime"].dataType, kind_of(arg.t["datetime"].dataType))
            return E(at_clock(local_of(inner).cast("date"), _nanos_of(arg)), t)
        return E(at_clock(_date_of(arg), _nanos_of(arg)), t)
    if arg.family == "string":
        day, rest = F.regexp_extract(arg.col, r"^([^T ]*)", 1), F.regexp_extract(arg.col, r"[T ](.*)$", 1)
        nanos = F.when(rest == "", F.lit(0).cast("long")).otherwise(clock(_split_zone(rest)[0]))
        return E(at_clock(date(E(day, T.StringType())).col, nanos), t)
    return E(local_of(arg), t)


def _moved_base(arg: E, offset: Column, zone: Column) -> E:
    """A map whose zoned datetime becomes the local one of the same instant in another zone."""
    if "datetime" not in arg.t.names or kind_of(arg.t["datetime"].dataType) != "zoned":
        return arg
    utc = arg.col["datetime"]["utc"]
    fixed = utc + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), offset.cast("decimal(18,6)"))
    named = F.from_utc_timestamp(utc.cast("timestamp"), zone).cast("timestamp_ntz")
    moved = E(F.when(offset.isNotNull(), fixed).otherwise(named), T.TimestampNTZType())
    return make_map([(f.name, moved if f.name == "datetime" else E(arg.col[f.name], f.dataType, kind_of(f.dataType))) for f in arg.t])


def zoned(arg: E) -> E:
    """A date-time with an offset or a named zone, kept as its UTC instant, offset and zone; UTC if none is given."""
    if arg.family == "zoned":
        return arg
    offset = zone = F.lit(None).cast("string")
    local = arg
    if arg.family == "string":
        day, rest = F.regexp_extract(arg.col, r"^([^T ]*)", 1), F.regexp_extract(arg.col, r"[T ](.*)$", 1)
        clock_text, offset, zone = _split_zone(rest)
        nanos = F.when(clock_text == "", F.lit(0).cast("long")).otherwise(clock(clock_text))
        ts = at_clock(date(E(day, T.StringType())).col, nanos)
    else:
        if arg.kind == "map" and "timezone" in arg.t.names:
            z = arg.col["timezone"]
            offset = F.when(offset_of(z).isNotNull(), z)
            zone = F.when(offset_of(z).isNull(), z)
            local = _moved_base(arg, offset_of(offset), zone)
        ts = localdatetime(local).col
    fixed = offset_of(offset)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))

    def utc_of(t: Column) -> Column:
        named = F.to_utc_timestamp(t.cast("timestamp"), F.coalesce(zone, F.lit("UTC"))).cast("timestamp_ntz")
        return let(fixed, lambda o: F.when(o.isNotNull(), t - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), o.cast("decimal(18,6)"))).otherwise(named))

    def whole(t: Column, utc: Column) -> Column:
        seconds = F.call_function("div", micros(t) - micros(utc), F.lit(1000000)).cast("int")
        return F.when(t.isNotNull(), F.struct(utc.alias("utc"), seconds.alias("utc_offset"), zone.alias("zone")))

    return E(let(ts, lambda t: let(utc_of(t), lambda u: whole(t, u))), ZONED, "zoned")


def add_to_clock(a: E, d: Column, sign: int) -> E:
    """Times wrap at 24 hours; a zoned date-time moves months and days on its local calendar, the rest on the time line."""
    nanos = (d["seconds"] * 1000000000 + d["nanos"]) * sign
    if a.family == "localtime":
        return E(F.struct(F.pmod(a.col["localtime_nanos"] + nanos, F.lit(DAY)).alias("localtime_nanos")), a.t, a.kind)
    if a.family == "time":
        return E(F.struct(F.pmod(a.col["time_nanos"] + nanos, F.lit(DAY)).alias("time_nanos"), a.col["time_offset"].alias("time_offset")), a.t, a.kind)

    def moved(a: Column, d: Column) -> Column:
        local = local_of(E(a, ZONED, "zoned")) + F.make_interval(F.lit(0), (d["months"] * sign).cast("int"), F.lit(0), (d["days"] * sign).cast("int"))
        step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ((d["seconds"] + d["nanos"] / F.lit(1e9)) * sign).cast("decimal(18,6)"))
        fixed = lambda l: l - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), a["utc_offset"].cast("decimal(18,6)"))
        zone = F.coalesce(a["zone"], F.lit("UTC"))
        return let(local, lambda l: F.when(a["zone"].isNull(), fixed(l)).otherwise(F.to_utc_timestamp(l.cast("timestamp"), zone).cast("timestamp_ntz")) + step)

    def whole(a: Column, utc: Column) -> Column:
        ts = utc.cast("timestamp")
        shifted = F.from_utc_timestamp(ts, F.coalesce(a["zone"], F.lit("UTC")))
        seconds = F.when(a["zone"].isNull(), a["utc_offset"]).otherwise(F.call_function("div", F.unix_micros(shifted) - F.unix_micros(ts), F.lit(1000000)).cast("int"))
        return F.struct(utc.alias("utc"), seconds.alias("utc_offset"), a["zone"].alias("zone"))

    return E(let(a.col, lambda x: let(d, lambda y: let(moved(x, y), lambda u: whole(x, u)))), ZONED, "zoned")


def now(kind: str, instant) -> E:
    ts = E(F.lit(instant.replace(tzinfo=None)).cast("timestamp_ntz"), T.TimestampNTZType())
    return {"date": date, "localtime": localtime, "time": time, "datetime": zoned}.get(kind, lambda e: e)(ts)


_DATE_PARTS = {"year": "YEAR", "month": "MONTH", "day": "DAY", "quarter": "QUARTER", "week": "WEEK", "weekYear": "YEAROFWEEK", "ordinalDay": "DOY", "hour": "HOUR", "minute": "MINUTE"}


def component(e: E, key: str) -> E:
    if e.family in ("zoned", "time", "duration"):
        made = _component(E(F.lit(None), e.t, e.kind), key)
        return NULL if made is NULL else once(e, lambda x: _component(x, key))
    return _component(e, key)


def _component(e: E, key: str) -> E:
    c = e.col
    if e.family == "duration":
        out = {
            "years": lambda: F.call_function("div", c["months"], F.lit(12)),
            "quarters": lambda: F.call_function("div", c["months"], F.lit(3)),
            "months": lambda: c["months"],
            "weeks": lambda: F.call_function("div", c["days"], F.lit(7)),
            "days": lambda: c["days"],
            "hours": lambda: F.call_function("div", c["seconds"], F.lit(3600)),
            "minutes": lambda: F.call_function("div", c["seconds"], F.lit(60)),
            "seconds": lambda: c["seconds"],
            "milliseconds": lambda: c["seconds"] * 1000 + F.call_function("div", c["nanos"], F.lit(1000000)),
            "microseconds": lambda: c["seconds"] * 1000000 + F.call_function("div", c["nanos"], F.lit(1000)),
            "nanoseconds": lambda: c["seconds"] * 1000000000 + c["nanos"],
            "quartersOfYear": lambda: F.call_function("div", c["months"] % 12, F.lit(3)),
            "monthsOfQuarter": lambda: c["months"] % 3,
            "monthsOfYear": lambda: c["months"] % 12,
            "daysOfWeek": lambda: c["days"] % 7,
            "minutesOfHour": lambda: F.call_function("div", c["seconds"] % 3600, F.lit(60)),
            "secondsOfMinute": lambda: c["seconds"] % 60,
            "millisecondsOfSecond": lambda: F.call_function("div", c["nanos"], F.lit(1000000)),
            "microsecondsOfSecond": lambda: F.call_function("div", c["nanos"], F.lit(1000)),
            "nanosecondsOfSecond": lambda: c["nanos"],
        }.get(key)
        return E(_long(out()), T.LongType()) if out else NULL
    if e.family in ("localtime", "time", "zoned"):
        if (found := _clock_component(e, key)) is not None:
            return E(found, T.StringType() if key in ("timezone", "offset") else T.LongType())
        if e.family != "zoned":
            return NULL
        if key in ("epochSeconds", "epochMillis"):
            return component(E(c["utc"], T.TimestampNTZType()), key)
        return component(E(local_of(e), T.TimestampNTZType()), key)
    if key in _DATE_PARTS:
        return E(_long(F.date_part(F.lit(_DATE_PARTS[key]), c)), T.LongType())
    if key in ("weekDay", "dayOfWeek"):
        return E(_long(F.weekday(c) + 1), T.LongType())
    if key == "dayOfQuarter":
        return E(_long(F.datediff(c.cast("date"), F.trunc(c.cast("date"), "quarter")) + 1), T.LongType())
    if e.family == "date":
        return NULL
    micros = lambda: F.unix_micros(c.cast("timestamp"))
    out = {
        "second": lambda: F.second(c),
        "millisecond": lambda: F.call_function("div", F.pmod(micros(), F.lit(1000000)), F.lit(1000)),
        "microsecond": lambda: F.pmod(micros(), F.lit(1000000)),
        "nanosecond": lambda: F.pmod(micros(), F.lit(1000000)) * 1000,
        "epochSeconds": lambda: F.unix_seconds(c.cast("timestamp")),
        "epochMillis": lambda: F.unix_millis(c.cast("timestamp")),
    }.get(key)
    return E(_long(out()), T.LongType()) if out else NULL


def _clock_component(e: E, key: str) -> Column | None:
    div = lambda a, k: F.call_function("div", a, F.lit(k))
    if e.family != "localtime":
        seconds = e.col["time_offset" if e.family == "time" else "utc_offset"]
        if key == "offsetSeconds":
            return _long(seconds)
        if key == "offsetMinutes":
            return _long(div(seconds, 60))
        if key == "offset":
            return offset_text(seconds)
        if key == "timezone":
            return F.coalesce(e.col["zone"], offset_text(seconds)) if e.family == "zoned" else offset_text(seconds)
    n = local_nanos(e)
    sub = n % 1000000000
    out = {"hour": lambda: div(n, 3600000000000), "minute": lambda: div(n, 60000000000) % 60, "second": lambda: div(n, 1000000000) % 60, "millisecond": lambda: div(sub, 1000000), "microsecond": lambda: div(sub, 1000), "nanosecond": lambda: sub}
    return _long(out[key]()) if key in out else None


def offset_text(seconds: Column) -> Column:
    size = F.abs(seconds)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    signed = F.concat(F.when(seconds < 0, F.lit("-")).otherwise(F.lit("+")), two(F.call_function("div", size, F.lit(3600))), F.lit(":"), two(F.call_function("div", size, F.lit(60)) % 60))
    return F.when(seconds == 0, F.lit("Z")).otherwise(signed)


def clock_text(n: Column) -> Column:
    """HH:MM, with seconds and a fraction where they aren't zero."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    div = lambda k: F.call_function("div", n, F.lit(k))
    fraction = F.when(n % 1000000000 != 0, F.concat(F.lit("."), F.rtrim(F.lpad((n % 1000000000).cast("string"), 9, "0"), F.lit("0")))).otherwise(F.lit(""))
    seconds = F.when(n % 60000000000 != 0, F.concat(F.lit(":"), two(div(1000000000) % 60), fraction)).otherwise(F.lit(""))
    return F.concat(two(div(3600000000000)), F.lit(":"), two(div(60000000000) % 60), seconds)


_CLOCK_UNITS = {"day": DAY, "hour": 3600000000000, "minute": 60000000000, "second": 1000000000, "millisecond": 1000000, "microsecond": 1000}


def truncate(kind: str, unit: E, e: E, parts: E | None = None) -> E:
    """The value cut to the unit; parts (a map) then replace single components."""
    out = once(e, lambda x: _truncate(kind, unit, x))
    if parts is None or isinstance(parts.t, T.NullType):
        return out
    if parts.kind != "map":
        raise CypherTypeError(f"{kind}.truncate() takes a map of components")
    return once(out, lambda x: _replaced(kind, x, parts))


def _replaced(kind: str, e: E, parts: E) -> E:
    fields = [(f.name, E(parts.col[f.name], f.dataType, kind_of(f.dataType))) for f in parts.t if not f.name.startswith("_")]
    sub_second = ("millisecond", "microsecond", "nanosecond")
    if kind != "date" and {n for n, _ in fields} & set(sub_second):
        # finer components than the given ones stay as they were cut
        given = {n for n, _ in fields}
        nanos = component(e, "nanosecond").col
        left = {"millisecond": F.call_function("div", nanos, F.lit(1000000)), "microsecond": F.call_function("div", nanos, F.lit(1000)) % 1000, "nanosecond": nanos % 1000}
        fields += [(n, E(left[n], T.LongType())) for n in sub_second if n not in given]
    if kind == "date":
        return date(make_map([("date", e), *fields]))
    if kind in ("localtime", "time"):
        return (localtime if kind == "localtime" else time)(make_map([("time", e), *fields]))
    if kind == "localdatetime":
        return localdatetime(make_map([("date", e), ("time", e), *fields]))
    wall = E(local_of(e), T.TimestampNTZType())
    if "timezone" not in parts.t.names:
        zone = F.coalesce(e.col["zone"], offset_text(e.col["utc_offset"]))
        fields.append(("timezone", E(zone, T.StringType())))
    return zoned(make_map([("date", wall), ("time", wall), *fields]))


def _truncate(kind: str, unit: E, e: E) -> E:
    """kind: what comes out; the unit is a literal."""
    u = str(unit.literal).lower()
    if kind in ("localtime", "time"):
        if u not in _CLOCK_UNITS:
            raise CypherTypeError(f"unknown unit {u}")
        n = local_nanos(e)
        n = n - n % _CLOCK_UNITS[u]
        if kind == "localtime":
            return E(F.struct(n.alias("localtime_nanos")), LOCALTIME, "localtime")
        return E(F.struct(n.alias("time_nanos"), time(e).col["time_offset"].alias("time_offset")), TIME, "time")
    if kind == "datetime":
        if e.family != "zoned":
            return once(zoned(e), lambda x: _truncate(kind, unit, x))
        z = e
        # the offset of a named zone can be another one at the cut instant
        local = _truncate("localdatetime", unit, z)
        zone = F.coalesce(z.col["zone"], offset_text(z.col["utc_offset"]))
        return zoned(make_map([("datetime", local), ("timezone", E(zone, T.StringType()))]))
    ts = local_of(e)
    years = {"millennium": 1000, "century": 100, "decade": 10}
    if u in years:
        y = F.call_function("div", F.year(ts), F.lit(years[u])) * years[u]
        out = F.make_date(y.cast("int"), F.lit(1), F.lit(1))
    elif u == "weekyear":
        out = week_date(F.date_part(F.lit("YEAROFWEEK"), ts).cast("int"), F.lit(1), F.lit(1))
    elif re.fullmatch("year|quarter|month|week|day|hour|minute|second|millisecond|microsecond", u):
        out = F.date_trunc(u, ts)
    else:
        raise CypherTypeError(f"unknown unit {u}")
    t = T.DateType() if kind == "date" else T.TimestampNTZType()
    return E(out.cast(t), t)


def between(a: E, b: E, mode: str = "between") -> E:
    return once(a, lambda x: once(b, lambda y: _between(x, y, mode)))


def _local_in(e: E, other: E) -> Column:
    """The local date-time of a zoned one in the zone of another."""
    fixed = e.col["utc"] + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), other.col["utc_offset"].cast("decimal(18,6)"))
    named = F.from_utc_timestamp(e.col["utc"].cast("timestamp"), F.coalesce(other.col["zone"], F.lit("UTC"))).cast("timestamp_ntz")
    return F.when(other.col["zone"].isNull(), fixed).otherwise(named)


def _in_zone_of(z: E, local: E) -> E:
    zone = F.coalesce(z.col["zone"], offset_text(z.col["utc_offset"]))
    return zoned(make_map([("datetime", E(local_of(local), T.TimestampNTZType())), ("timezone", E(zone, T.StringType()))]))


def _between(a: E, b: E, mode: str) -> E:
    """Whole months, then days, then the rest (between), or one of them only."""
    times = ("localtime", "time")
    if a.family in times or b.family in times:
        if mode in ("inmonths", "indays"):
            none = F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(0)).cast("long")
            return E(F.when(none.isNotNull(), F.struct(*[none.alias(n) for n in DURATION.names])), DURATION, "duration")
        # without a date on one side, only the times differ
        nanos = local_nanos(b) - local_nanos(a)
        offsets = {"time": "time_offset", "zoned": "utc_offset"}
        if a.family in offsets and b.family in offsets:
            nanos = nanos - (b.col[offsets[b.family]] - a.col[offsets[a.family]]).cast("long") * 1000000000
        s = F.floor(nanos / F.lit(1000000000)).cast("long")
        zero = F.lit(0).cast("long")
        return E(F.struct(zero.alias("months"), zero.alias("days"), s.alias("seconds"), (nanos - s * 1000000000).alias("nanos")), DURATION, "duration")
    both_zoned = a.family == b.family == "zoned"
    if mode == "inseconds" and not both_zoned and "zoned" in (a.family, b.family):
        # the local one is read in the zone of the other
        return between(*(e if e.family == "zoned" else _in_zone_of(b if a is e else a, e) for e in (a, b)), mode)
    x, y = local_of(a), local_of(b)
    if both_zoned:
        x, y = (a.col["utc"], b.col["utc"]) if mode == "inseconds" else (x, _local_in(b, a))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    zero = F.lit(0).cast("long")

    def rest(from_: Column) -> tuple[Column, Column]:
        d = micros(y) - micros(from_)
        s = F.floor(d / F.lit(1000000)).cast("long")
        return s, (d - s * 1000000) * 1000

    if mode == "inseconds":
        s, n = rest(x)
        return E(F.struct(zero.alias("months"), zero.alias("days"), s.alias("seconds"), n.alias("nanos")), DURATION, "duration")
    m = (F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x)
    back = lambda k: x + F.make_interval(F.lit(0), k.cast("int"))
    m = F.when((m > 0) & (back(m) > y), m - 1).when((m < 0) & (back(m) < y), m + 1).otherwise(m)
    if mode == "indays":
        m = F.lit(0)
    base = back(m)
    d = micros(y) - micros(base)
    days = F.call_function("div", d, F.lit(86400000000))
    left = d - days * 86400000000
    if both_zoned:  # hours that a change of the clocks adds or takes
        left = F.when((m == 0) & (days == 0), micros(b.col["utc"]) - micros(a.col["utc"])).otherwise(left)
    s = F.floor(left / F.lit(1000000)).cast("long")
    out = {"months": _long(m), "days": _long(days), "seconds": s, "nanos": (left - s * 1000000) * 1000}
    if mode == "inmonths":
        out |= {"days": zero, "seconds": zero, "nanos": zero}
    if mode == "indays":
        out |= {"months": zero, "seconds": zero, "nanos": zero}
    return E(F.struct(*[v.alias(k) for k, v in out.items()]), DURATION, "duration")


def text(e: E) -> Column:
    if e.family in ("zoned", "time", "localtime", "localdatetime", "duration"):
        return let(e.col, lambda c: _text(E(c, e.t, e.kind)))
    return _text(e)


def _text(e: E) -> Column:
    """ISO text of a duration; Spark's own for the rest."""
    if e.family == "localtime":
        return clock_text(e.col["localtime_nanos"])
    if e.family == "time":
        return F.concat(clock_text(e.col["time_nanos"]), offset_text(e.col["time_offset"]))
    if e.family in ("zoned", "localdatetime"):
        local = F.concat(local_of(e).cast("date").cast("string"), F.lit("T"), clock_text(local_nanos(e)))
        if e.family == "localdatetime":
            return local
        return F.concat(local, offset_text(e.col["utc_offset"]), F.coalesce(F.concat(F.lit("["), e.col["zone"], F.lit("]")), F.lit("")))
    if e.family == "float":
        return float_text(e.col)
    if e.family != "duration":
        return e.col.cast("string")
    c = e.col
    put = lambda v, u: F.when(v != 0, F.concat(v.cast("string"), F.lit(u))).otherwise(F.lit(""))
    div = lambda v, k: F.call_function("div", v, F.lit(k))
    # seconds are rounded down, so below zero the fraction counts back from the next one
    carry = F.floor(c["nanos"] / F.lit(1000000000)).cast("long")
    whole_seconds, nanos = c["seconds"] + carry, c["nanos"] - carry * 1000000000
    below = (whole_seconds < 0) & (nanos > 0)
    total, nanos = F.when(below, whole_seconds + 1).otherwise(whole_seconds), F.when(below, F.lit(1000000000) - nanos).otherwise(nanos)
    seconds = total % 60
    fraction = F.when(nanos != 0, F.concat(F.lit("."), F.rtrim(F.lpad(nanos.cast("string"), 9, "0"), F.lit("0")))).otherwise(F.lit(""))
    shown = F.concat(F.when(below & (seconds == 0), F.lit("-")).otherwise(F.lit("")), seconds.cast("string"), fraction, F.lit("S"))
    time = F.concat(put(div(total, 3600), "H"), put(div(total % 3600, 60), "M"), F.when((seconds != 0) | (nanos != 0), shown).otherwise(F.lit("")))
    days = F.concat(put(div(c["months"], 12), "Y"), put(c["months"] % 12, "M"), put(c["days"], "D"))
    whole = F.concat(F.lit("P"), days, F.when(time != "", F.concat(F.lit("T"), time)).otherwise(F.lit("")))
    return F.when(whole == "P", F.lit("PT0S")).otherwise(whole)
