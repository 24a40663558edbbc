"""Dates: period starts, pushable ranges, parsing and calendars.

All results are DATE (``F.trunc``), never TIMESTAMP (``F.date_trunc``).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

_TRUNC = {"week": "WEEK", "month": "MM", "quarter": "QUARTER", "year": "YYYY"}
_INTERVAL = {
    "day": "INTERVAL 1 DAY",
    "week": "INTERVAL 7 DAY",
    "month": "INTERVAL 1 MONTH",
    "quarter": "INTERVAL 3 MONTH",
    "year": "INTERVAL 1 YEAR",
}


def period_start(moment: Column, step: str) -> Column:
    """First day of the day, week, month, quarter or year."""
    if step == "day":
        return moment.cast("date")
    return F.trunc(moment, _TRUNC[step])


def month_start(moment: Column) -> Column:
    return period_start(moment, "month")


def quarter_start(moment: Column) -> Column:
    return period_start(moment, "quarter")


def next_period(start: Column, step: str) -> Column:
    return (start + F.expr(_INTERVAL[step])).cast("date")


def periods_between(first: Column, last: Column, step: str) -> Column:
    """Array of period starts, both ends included; NULL when first > last."""
    return F.when(first <= last, F.sequence(first, last, F.expr(_INTERVAL[step])))


def in_year(day: Column, year: int) -> Column:
    """A year as a date range: unlike ``year(day) = k`` it reaches the parquet scan."""
    return (day >= F.lit(date(year, 1, 1))) & (day < F.lit(date(year + 1, 1, 1)))


def try_date(text: Column, *formats: str) -> Column:
    """Text to DATE, ISO first and then ``formats`` in turn; NULL if none fits."""
    iso = F.trim(text).try_cast("date")
    others = [F.try_to_timestamp(F.trim(text), F.lit(f)).cast("date") for f in formats]
    return F.coalesce(iso, *others) if others else iso
