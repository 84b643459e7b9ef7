"""Dates, times and date-times in their compact text forms. Times are nanoseconds since midnight, as upper bounds end in 999 ns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR
_TM = r"^(\d{2})(?::?(\d{2})(?::?(\d{2})(?:\.(\d{0,6}))?)?)?$"
_DT = r"^(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:\.(\d{1,6}))?([+-]\d{4})?$"


def _group(text: Column, pattern: str, k: int) -> Column:
    g = F.regexp_extract(text, pattern, k)
    return F.when(F.length(g) > 0, g)


def _long(c: Column) -> Column:
    return c.cast("long")


def parse_da(text: Column) -> Column:
    """yyyyMMdd; a dot may stand after the year and after the month, each by itself."""
    t = F.trim(text)
    digits = F.when(t.rlike(r"^\d{4}\.?\d{2}\.?\d{2}$"), F.replace(t, F.lit("."), F.lit("")))
    return F.try_to_date(digits, "yyyyMMdd")


def format_da(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd")


def _fraction_ns(digits: Column) -> Column:
    return _long(F.rpad(F.coalesce(digits, F.lit("0")), 9, "0"))


def _valid_time(h: Column, m: Column, s: Column) -> Column:
    return (h < 24) & (m < 60) & (s < 60)


def parse_tm(text: Column) -> Column:
    """HH[[:]mm[[:]ss[.f]]] as nanoseconds of the day; null if malformed."""
    t = F.trim(text)
    h, m, s = (F.coalesce(_long(_group(t, _TM, k)), F.lit(0)) for k in (1, 2, 3))
    return F.when(t.rlike(_TM) & _valid_time(h, m, s), h * HOUR + m * MINUTE + s * SECOND + _fraction_ns(_group(t, _TM, 4)))


def _fill(digits: Column) -> Column:
    """From a fraction of n digits, how many nanoseconds to its last one."""
    n = F.coalesce(F.length(digits), F.lit(0))
    return F.pow(F.lit(10.0), 9 - n).cast("long") - 1


def parse_tm_max(text: Column) -> Column:
    """The last nanosecond of the stated precision."""
    t = F.trim(text)
    m, s = _group(t, _TM, 2), _group(t, _TM, 3)
    extra = F.when(m.isNull(), HOUR - 1).when(s.isNull(), MINUTE - 1).otherwise(_fill(_group(t, _TM, 4)))
    return parse_tm(text) + extra


def format_tm(ns: Column) -> Column:
    """HHmmss.SSSSSS"""
    micros = F.floor(ns % SECOND / 1000)
    return F.format_string("%02d%02d%02d.%06d", F.floor(ns / HOUR), F.floor(ns % HOUR / MINUTE), F.floor(ns % MINUTE / SECOND), micros)


def parse_dt(text: Column) -> Column:
    """4 to 14 digits, a fraction, an offset: nanoseconds since 1970, the offset taken off if there is one. Missing parts are the first."""
    t = F.trim(text)
    y, mo, d, h, mi, s = (_group(t, _DT, k) for k in range(1, 7))
    day = F.try_to_date(F.concat(y, F.coalesce(mo, F.lit("01")), F.coalesce(d, F.lit("01"))), "yyyyMMdd")
    h, mi, s = (F.coalesce(_long(x), F.lit(0)) for x in (h, mi, s))
    zone = _group(t, _DT, 8)
    shift = F.when(zone.isNull(), F.lit(0)).otherwise((_long(F.substring(zone, 2, 2)) * HOUR + _long(F.substring(zone, 4, 2)) * MINUTE) * F.when(zone.startswith("-"), -1).otherwise(1))
    ns = F.unix_date(day).cast("long") * DAY + h * HOUR + mi * MINUTE + s * SECOND + _fraction_ns(_group(t, _DT, 7)) - shift
    return F.when(t.rlike(_DT) & _valid_time(h, mi, s), ns)


def parse_dt_max(text: Column) -> Column:
    """The last nanosecond of the stated precision, of a year, month or day too."""
    t = F.trim(text)
    y, mo, d, h, mi, s = (_group(t, _DT, k) for k in range(1, 7))
    start = F.try_to_date(F.concat(y, F.coalesce(mo, F.lit("01")), F.coalesce(d, F.lit("01"))), "yyyyMMdd")
    days = F.when(mo.isNull(), F.date_diff(F.add_months(start, 12), start)).when(d.isNull(), F.date_diff(F.add_months(start, 1), start))
    extra = (
        F.when(days.isNotNull(), days.cast("long") * DAY - 1)
        .when(h.isNull(), DAY - 1)
        .when(mi.isNull(), HOUR - 1)
        .when(s.isNull(), MINUTE - 1)
        .otherwise(_fill(_group(t, _DT, 7)))
    )
    return parse_dt(text) + extra


def format_dt(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss.SSSSSS")


def combine(day: Column, ns: Column) -> Column:
    """Nanoseconds since 1970 of a date and a time; no date gives null, no time midnight."""
    return F.unix_date(day).cast("long") * DAY + F.coalesce(ns, F.lit(0))


def truncate(text: Column, most: int, zone_aware: bool = False) -> Column:
    """At most so many characters before the zone suffix; without room for a fraction, an even number of them."""
    zone = F.regexp_extract(text, r"([+-]\d{4})$", 1) if zone_aware else F.lit("")
    body = F.substring(text, F.lit(1), F.length(text) - F.length(zone))
    point = 16 if zone_aware else 8
    keep = most if most >= point else most // 2 * 2
    return F.when(F.length(body) <= most, text).otherwise(F.concat(F.substring(body, 1, keep), zone))


def whole_months(birth: Column, day: Column) -> Column:
    months = (F.year(day) - F.year(birth)) * 12 + F.month(day) - F.month(birth)
    return months - F.when(F.dayofmonth(day) < F.dayofmonth(birth), 1).otherwise(0)


def age(birth: Column, day: Column) -> Column:
    """Whole years from two on, else whole months from two on, else days: nnnY, nnnM, nnnD."""
    months = whole_months(birth, day)
    years = F.floor(months / 12)
    return F.when(years >= 2, F.format_string("%03dY", years)).when(months >= 2, F.format_string("%03dM", months)).otherwise(F.format_string("%03dD", F.date_diff(day, birth)))
