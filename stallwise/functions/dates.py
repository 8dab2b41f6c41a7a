"""Calendar functions, with weeks that start on Sunday."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday names in the order of dayofweek (1 = Sunday).
WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def day(moment: Column | str) -> Column:
    return F.to_date(moment)


def within_days(moment: Column | str, start: dt.date | None, end: dt.date, kind: str = "timestamp_ntz") -> Column:
    """``start`` <= day of ``moment`` <= ``end``, written on the raw column; without a start, up to ``end``.

    ``kind`` is the type of the column (``date`` for a partition column).  The
    bounds are constants of that type, so the test prunes partitions and reaches
    the parquet reader instead of hiding behind a cast.
    """
    moment = F.col(moment) if isinstance(moment, str) else moment
    before = moment < F.lit(end + dt.timedelta(days=1)).cast(kind)
    return before if start is None else (moment >= F.lit(start).cast(kind)) & before


def month_start(date: Column | str) -> Column:
    return F.trunc(date, "MM")


def year_start(date: Column | str) -> Column:
    return F.trunc(date, "YEAR")


def next_month(date: Column) -> Column:
    return F.add_months(month_start(date), 1)


def sunday_week(date: Column) -> Column:
    """The Sunday on or before a date (Spark's own week starts on Monday)."""
    return F.date_sub(date, F.dayofweek(date) - 1)


def iso_week_label(date: Column) -> Column:
    """ISO year and week, for example ``2020-53``."""
    return F.concat_ws(
        "-",
        F.extract(F.lit("YEAROFWEEK"), date).cast("string"),
        F.lpad(F.weekofyear(date).cast("string"), 2, "0"),
    )


def weekday_label(date: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in WEEKDAYS]), F.dayofweek(date))


def numbered_weekday(date: Column) -> Column:
    """Weekday label that sorts from Monday on, for example ``1 - Mon``."""
    number = F.weekday(date) + 1
    return F.concat(number.cast("string"), F.lit(" - "), F.left(weekday_label(date), F.lit(3)))


def local_day(moment_utc: Column, zone: Column) -> Column:
    """Date on the wall clock of the row's own time zone."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), zone, moment_utc))


def day_series(start: Column, end: Column) -> Column:
    """Every date from start to end, both included; empty when end < start."""
    none = F.array().cast("array<date>")
    return F.when(start <= end, F.sequence(start, end)).when(start > end, none)


# Bounds worked out on the driver, from the run date.


def minus_months(date: dt.date, months: int) -> dt.date:
    """The same day some months earlier, clamped to the end of that month."""
    index = date.year * 12 + date.month - 1 - months
    year, month = divmod(index, 12)
    following = dt.date(year + (month == 11), (month + 1) % 12 + 1, 1)
    last = (following - dt.timedelta(days=1)).day
    return dt.date(year, month + 1, min(date.day, last))


def first_of_month(date: dt.date) -> dt.date:
    return date.replace(day=1)
