"""Calendar periods and date ranges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

GRANULARITIES = ("Day", "Week", "Month", "Year")

# --- fixed values: names of the relative date ranges ------------------------
RELATIVE_RANGES = (
    "Today",
    "This week",
    "This month",
    "This year",
    "Last 60 days",
    "Last 90 days",
    "Last 6 months",
    "Last 12 months",
    "All time",
)


def period_of(day: Column, granularity: str) -> Column:
    """Label of the period a day lies in: the day, the Sunday that ends the
    week, or the first day of the month or year."""
    if granularity == "Day":
        return day
    if granularity == "Week":
        return F.next_day(F.date_sub(day, 1), "SUN")
    if granularity in ("Month", "Year"):
        return F.trunc(day, granularity.lower()).cast("date")
    raise ValueError(f"granularity must be one of {GRANULARITIES}, not {granularity!r}")


def period_step(granularity: str) -> Column:
    """Length of one period as an interval."""
    steps = {"Day": {"days": 1}, "Week": {"weeks": 1}, "Month": {"months": 1}, "Year": {"years": 1}}
    return F.make_interval(**{unit: F.lit(n) for unit, n in steps[granularity].items()})


def next_period(label: Column, granularity: str) -> Column:
    """The label moved on by one period (plots put bars at the period's end)."""
    if granularity == "Day":
        return F.date_add(label, 1)
    if granularity == "Week":
        return F.date_add(label, 7)
    return F.add_months(label, 1 if granularity == "Month" else 12)


def relative_range(name: str, as_of: dt.date, first_day: dt.date | None = None):
    """(start, stop) of a named range that ends at ``as_of``.

    'This week' starts on the Sunday before this week's Monday.  'All time'
    starts at ``first_day``.
    """
    starts = {
        "Today": as_of,
        "This week": as_of - dt.timedelta(days=as_of.weekday() + 1),
        "This month": as_of.replace(day=1),
        "This year": as_of.replace(month=1, day=1),
        "Last 60 days": as_of - dt.timedelta(days=60),
        "Last 90 days": as_of - dt.timedelta(days=90),
        "Last 6 months": as_of - dt.timedelta(days=180),
        "Last 12 months": as_of - dt.timedelta(days=365),
        "All time": first_day,
    }
    if name not in starts:
        raise ValueError(f"unknown date range {name!r}")
    return starts[name], as_of
