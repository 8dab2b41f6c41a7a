"""Projection of month-to-date promotion cost to the end of the month."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from stallwise.functions.dates import first_of_month, month_start, next_month
from stallwise.functions.numeric import safe_ratio, strict_greatest, strict_least


def campaign_factor(as_of: dt.date, start: Column, end: Column, first_order: Column) -> Column:
    """Days the campaign will run this month over the days it has run so far.

    The month is that of the day before ``as_of``.  Campaigns that do not run on
    that day, or whose first order lies in another month, keep the factor 1.
    """
    seen = as_of - dt.timedelta(days=1)
    today = F.lit(seen)
    month = F.lit(first_of_month(seen))
    month_end = F.last_day(month)
    begin = strict_greatest(start, month)
    finish = strict_greatest(strict_least(end, month_end), today)
    running = (start <= today) & (end >= today) & (month_start(first_order) == month)
    factor = safe_ratio(F.datediff(finish, begin) + 1, F.datediff(today, begin) + 1)
    return F.when(running, factor).otherwise(F.lit(1.0))


def open_factor(as_of: dt.date, first_order: Column) -> Column:
    """Length of the month over the days seen, for promotions without a limit."""
    seen = as_of - dt.timedelta(days=1)
    month = F.lit(first_of_month(seen))
    length = F.datediff(next_month(month), month)
    factor = safe_ratio(length, F.datediff(F.lit(seen), month) + 1)
    return F.when(month_start(first_order) == month, factor).otherwise(F.lit(1.0))


def redemption_projection(
    as_of: dt.date, cost: Column, start: Column, stop: Column, on: Column
) -> Column:
    """Month-end value of one redemption; 0 outside the running month.

    On the first day of a campaign or month no day is behind us: the quotient is
    NULL, and a later sum leaves the row out.
    """
    today = F.lit(as_of)
    month = F.lit(first_of_month(as_of))
    finish = strict_least(stop, F.last_day(today))
    per_day = safe_ratio(cost, F.datediff(today, strict_greatest(start, month)))
    rest = per_day * F.datediff(finish, F.date_sub(today, 1))
    return F.when((on >= month) & (on <= finish), cost.cast("double") + rest).otherwise(F.lit(0.0))
