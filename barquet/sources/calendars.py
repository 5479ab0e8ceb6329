"""Exchange sessions by rule: a small dimension ``calendar, session, close_utc``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

VERSION = "rules-1"
CLOSE, EARLY_CLOSE = dt.time(16), dt.time(13)
#: Days on which New York was closed outside the yearly rules.
SPECIAL_CLOSURES = (dt.date(2001, 9, 11), dt.date(2001, 9, 12), dt.date(2001, 9, 13), dt.date(2001, 9, 14), dt.date(2004, 6, 11), dt.date(2007, 1, 2), dt.date(2012, 10, 29), dt.date(2012, 10, 30), dt.date(2018, 12, 5), dt.date(2025, 1, 9))


def _easter(year: int) -> dt.date:
    """Western Easter by the anonymous Gregorian computus."""
    a, (b, c) = year % 19, divmod(year, 100)
    d = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    e = (32 + 2 * (b % 4) + 2 * (c // 4) - d - c % 4) % 7
    m, k = divmod(d + e - 7 * ((a + 11 * d + 22 * e) // 451) + 114, 31)
    return dt.date(year, m, k + 1)


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th such weekday of a month, from its end if n is negative."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7)


def _observed(day: dt.date) -> dt.date | None:
    """A Sunday holiday moves to Monday, a Saturday one to Friday, unless that ends a year."""
    if day.weekday() == 6:
        return day + dt.timedelta(1)
    if day.weekday() == 5:
        return None if (day.month, day.day) == (1, 1) else day - dt.timedelta(1)
    return day


def holidays(year: int) -> set[dt.date]:
    fixed = [dt.date(year, 1, 1), dt.date(year, 7, 4), dt.date(year, 12, 25)] + ([dt.date(year, 6, 19)] if year >= 2022 else [])
    moving = [_nth(year, 1, 0, 3), _nth(year, 2, 0, 3), _easter(year) - dt.timedelta(2), _nth(year, 5, 0, -1), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4)]
    return {d for d in (*map(_observed, fixed), *moving, *SPECIAL_CLOSURES) if d}


def early_closes(year: int) -> set[dt.date]:
    """The day after Thanksgiving, Christmas Eve and the day before Independence Day, if sessions."""
    july = dt.date(year, 7, 3)
    return {_nth(year, 11, 3, 4) + dt.timedelta(1), dt.date(year, 12, 24)} | ({july} if july.weekday() < 4 else set())


def _new_york_offset(day: dt.date) -> int:
    """Hours from New York's clock to UTC at a close on that day (rules since 2007)."""
    return 4 if _nth(day.year, 3, 6, 2) <= day < _nth(day.year, 11, 6, 1) else 5


def xnys_sessions(start: dt.date, end: dt.date) -> list[tuple[str, dt.date, dt.datetime]]:
    out = []
    for day in (start + dt.timedelta(k) for k in range((end - start).days + 1)):
        if day.weekday() < 5 and day not in holidays(day.year):
            close = dt.datetime.combine(day, EARLY_CLOSE if day in early_closes(day.year) else CLOSE)
            out.append(("XNYS", day, close + dt.timedelta(hours=_new_york_offset(day))))
    return out


def sessions(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    return spark.createDataFrame(xnys_sessions(start, end), "calendar string, session date, close_utc timestamp_ntz")
