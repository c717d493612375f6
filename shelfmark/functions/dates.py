"""Dates written in running text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _date(year: Column, month: Column, day: Column) -> Column:
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    # A month or day outside the calendar gives NULL.
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group).try_cast("int")


def natural_date(c: Column, today: Column) -> Column:
    """ISO date, then ``6月10日``, then ``6/10``; a past day without a year moves to next year."""
    iso = r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})"
    month_day = r"(\d{1,2})\s*月\s*(\d{1,2})\s*[日号]?"
    slash = r"(\d{1,2})/(\d{1,2})"

    def yearless(pattern: str) -> Column:
        month, day = _part(c, pattern, 1), _part(c, pattern, 2)
        this, following = _date(F.year(today), month, day), _date(F.year(today) + 1, month, day)
        return F.when(this < today, following).otherwise(this)

    return F.coalesce(
        _date(_part(c, iso, 1), _part(c, iso, 2), _part(c, iso, 3)),
        yearless(month_day),
        yearless(slash),
    )


def days_left(day: Column, today: Column) -> Column:
    return F.datediff(day, today)
