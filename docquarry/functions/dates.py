"""Calendar functions: horizon buckets, orientation, Jalali and Hijri conversion."""

from __future__ import annotations

from datetime import date, timedelta
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def horizon_bucket(first: Column, last: Column, orientation: Column, as_of: Column) -> Column:
    """Where a range of days stands against a reference day; null without a date.

    A range that has ended is overdue if the text spoke of the future, else past; all others
    go by their first day.
    """
    ahead = F.datediff(first, as_of)
    ended = F.when(orientation == "future", "overdue").otherwise("past")
    return F.when(first.isNotNull(), F.when(last < as_of, ended).when(ahead < 7, "week").when(ahead < 30, "month").when(ahead < 90, "quarter").otherwise("later"))


def imminent(first: Column, last: Column, as_of: Column) -> Column:
    """Whether the range shares a day with the week from ``as_of``; never without a date."""
    return F.coalesce((F.coalesce(last, first) >= as_of) & (first < F.date_add(as_of, 7)), F.lit(False))


def overlaps(first: Column, last: Column, start: Column, end: Column) -> Column:
    """Whether two date ranges share a day; an undated range never does."""
    return F.coalesce((last >= start) & (first <= end), F.lit(False))


def orientation(first: Column, last: Column, ref: Column) -> Column:
    """past, future or current, of a range against a day."""
    return F.when(last < ref, "past").when(first > ref, "future").when(first.isNotNull(), "current")


def hijri_to_gregorian(year: int, month: int, day: int) -> date:
    """The tabular Islamic calendar (civil epoch); true sightings differ by up to two days."""
    days = day + (59 * (month - 1) + 1) // 2 + (year - 1) * 354 + (3 + 11 * year) // 30 - 1
    return date(622, 7, 19) + timedelta(days=days)


#: The years in which the run of Jalali leap cycles changes.
_JALALI_BREAKS = (-61, 9, 38, 199, 426, 686, 756, 818, 1111, 1181, 1210, 1635, 2060, 2097, 2192, 2262, 2324, 2394, 2456, 3178)


@lru_cache(1)
def _jalali_leaps() -> tuple[tuple[int, ...], frozenset[int]]:
    """Leap days before each year from the first break on, and the leap years.

    Within a run, 33 years hold eight leap years: every fourth from the first on, but not the
    last of the 33. The last five years of a run stand where they would if it ended with a
    whole number of 33 years.
    """
    leaps = set()
    for start, stop in zip(_JALALI_BREAKS, _JALALI_BREAKS[1:]):
        for year in range(start, stop):
            place = (year - start if stop - year > 5 else year - stop) % 33
            if place % 4 == 0 and place != 32:
                leaps.add(year)
    before, count = [], 0
    for year in range(_JALALI_BREAKS[0], _JALALI_BREAKS[-1]):
        before.append(count)
        count += year in leaps
    return tuple(before), frozenset(leaps)


def jalali_leap(year: int) -> bool:
    """Whether the year's last month has 30 days."""
    return year in _jalali_leaps()[1]


def _jalali_new_year(year: int) -> date:
    """Day 1 of a year: so many years of 365 days and leap days after that of 1403."""
    before = _jalali_leaps()[0]
    leap_days = before[year - _JALALI_BREAKS[0]] - before[1403 - _JALALI_BREAKS[0]]
    return date(2024, 3, 20) + timedelta(days=365 * (year - 1403) + leap_days)


def jalali_to_gregorian(year: int, month: int, day: int) -> date:
    """A Solar Hijri date: six months of 31 days, then 30, the last of 29 or 30."""
    lengths = [31] * 6 + [30] * 5 + [30 if jalali_leap(year) else 29]
    if not (1 <= month <= 12 and 1 <= day <= lengths[month - 1]) or not 1 <= year < _JALALI_BREAKS[-1]:
        raise ValueError("no such day")
    return _jalali_new_year(year) + timedelta(days=sum(lengths[: month - 1]) + day - 1)
