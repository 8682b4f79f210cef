"""Instants and calendar days in Rome, ``Column -> Column``. Instants are UTC; the session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeloom.functions import patterns as P
from noticeloom.functions.text import fold
from noticeloom.settings import ZONE


def rome(instant: Column) -> Column:
    """The wall clock in Rome."""
    return F.from_utc_timestamp(instant, ZONE)


def rome_day(instant: Column) -> Column:
    return F.to_date(rome(instant))


def rome_instant(day: Column, seconds: Column) -> Column:
    """The instant of a wall clock: a day and the seconds since its midnight. Of an hour that comes twice, the later."""
    wall = F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + seconds.cast("long"))
    first = F.to_utc_timestamp(wall, ZONE)
    later = first + F.expr("INTERVAL 1 HOUR")
    return F.when(rome(later) == wall, later).otherwise(first)


def rolled_day(year: Column, month: Column, day: Column) -> Column:
    """31 February is 3 March (2 in a leap year)."""
    return F.date_add(F.make_date(year, month, F.lit(1)), day - 1)


_LONG_DATE = r"(\d{1,2})\s+([a-z]+)\s+(\d{4})(?:\s+ore\s+(\d{1,2})[:.](\d{2}))?"


def long_date_instant(line: Column) -> Column:
    """``24 Settembre 2026 ore 10:23`` as an instant, or null."""
    t = fold(line)
    part = [F.nullif(F.regexp_extract(t, _LONG_DATE, i), F.lit("")) for i in range(6)]
    month = F.nullif(F.array_position(F.array(*map(F.lit, P.MONTHS)), part[2]).cast("int"), F.lit(0))
    seconds = F.coalesce(part[4].try_cast("int"), F.lit(0)) * 3600 + F.coalesce(part[5].try_cast("int"), F.lit(0)) * 60
    return F.when(month.isNotNull(), rome_instant(rolled_day(part[3].try_cast("int"), month, part[1].try_cast("int")), seconds))


def without_hour(deadline: Column) -> Column:
    """Whether a deadline named no hour: it stands at the last second of the day."""
    return F.date_format(rome(deadline), "HH:mm:ss") == "23:59:59"


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def short_day(instant: Column) -> Column:
    return F.date_format(rome(instant), "dd/MM")


def italian_minute(instant: Column) -> Column:
    return F.date_format(rome(instant), "yyyy-MM-dd HH:mm")


def long_day(day: Column) -> Column:
    """``24 set 2026``."""
    return F.concat_ws(" ", F.dayofmonth(day).cast("string"), F.element_at(F.array(*map(F.lit, P.SHORT_MONTHS)), F.month(day)), F.year(day).cast("string"))


def least_distance_days(left: Column, right: Column) -> Column:
    """The least distance, in fractional days, of two lists of instants; null if one is empty."""
    every = F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.abs(F.unix_micros(a) - F.unix_micros(b)))))
    return F.array_min(every) / F.lit(86_400_000_000.0)
