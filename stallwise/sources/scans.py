"""Bounded scans of date-partitioned facts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions.dates import first_of_month, minus_months, within_days


def local_window(
    fact: DataFrame,
    moment_utc: str,
    local_date: Column,
    start: dt.date,
    end: dt.date,
    pad_days: int = 1,
    kind: str = "timestamp_ntz",
) -> DataFrame:
    """Rows whose local date lies in [start, end].

    The fact is laid out by UTC time, so the scan is bounded on the UTC column,
    a day wider at both ends, and the local date decides within it.  ``kind`` is
    the type of the UTC column.
    """
    pad = dt.timedelta(days=pad_days)
    return fact.filter(within_days(moment_utc, start - pad, end + pad, kind)).filter(local_date.between(start, end))


def since_month_start(fact: DataFrame, moment: str, as_of: dt.date, months: int) -> DataFrame:
    """Rows from the first day of the month ``months`` before the run date, up to it."""
    return fact.filter(within_days(moment, first_of_month(minus_months(as_of, months)), as_of))


def last_days(fact: DataFrame, moment: str, as_of: dt.date, days: int) -> DataFrame:
    """Rows of the ``days`` before the run date, and of the run date."""
    return fact.filter(within_days(moment, as_of - dt.timedelta(days=days), as_of))


def between_scalars(fact: DataFrame, column: str, first: DataFrame, last: DataFrame) -> DataFrame:
    """Rows between two bounds, each a one-row, one-column relation."""
    return fact.filter(F.col(column).between(first.scalar(), last.scalar()))
