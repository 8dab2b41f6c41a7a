"""Promotion cost and performance: proration, run rates, caps, before/during, per seller.

A promotion is run per brand.  Its interval, quota and kind follow fixed rules
on the number of the brand; a promoted line is one with a high discount.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.functions.dates import (
    day,
    day_series,
    first_of_month,
    minus_months,
    month_start,
    within_days,
)
from stallwise.functions.numeric import (
    TICKS,
    amount,
    exact_sum,
    safe_ratio,
    strict_greatest,
    strict_least,
    total,
)
from stallwise.functions.promo import campaign_factor, open_factor, redemption_projection
from stallwise.operators.aggregates import count_where, ordered_text
from stallwise.operators.joins import band_join, spread_join
from stallwise.operators.ranking import first_per_key
from stallwise.plans.orders import PERCENT_TICKS, PLATFORM_SHARE_OF_DISCOUNT, first_valid_days
from stallwise.session import checkpointed
from stallwise.sources.tables import (
    Tables,
    discount_amount,
    gross,
    is_failed,
    is_promo_line,
    is_valid,
    net,
)


def shifted(date: Column, days: Column) -> Column:
    return F.date_add(date, days.cast("int"))


# --- proration -----------------------------------------------------------------


def prorated(campaigns: DataFrame, start: str, end: str, cost: Column, keys: list[str]) -> DataFrame:
    """Cost of each campaign in each month it touches: cost per day times its days there.

    Months, not days, are unnested: the days of a month follow from its overlap
    with the interval, so a campaign gives one row per month instead of one per
    day.  Reversed intervals touch no month.  Shares are decimal ticks, so that
    rounding and summing them do not depend on row order.
    """
    begin, finish = F.col(start), F.col(end)
    months = F.sequence(month_start(begin), month_start(finish), F.expr("INTERVAL 1 MONTH"))
    listed = campaigns.filter(begin <= finish).withColumn("month", F.explode(months))
    covered = F.datediff(F.least(finish, F.last_day("month")), F.greatest(begin, F.col("month"))) + 1
    length = F.datediff(finish, begin) + 1
    exact = lambda days: days.cast("decimal(7,0)")
    share = (cost.cast("decimal(18,0)") * exact(covered) / exact(length)).cast("decimal(28,6)")
    return listed.select(*keys, "month", covered.alias("days"), share.alias("month_cost"))


def order_campaigns(t: Tables) -> DataFrame:
    """One campaign per order: its net value, spread over some days from the order date."""
    values = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(net()).alias("cost"), F.max("l_quantity").alias("quantity")
    )
    orders = t.orders.select("o_orderkey", day("o_orderdate").alias("start_day"))
    return orders.join(values, "o_orderkey").withColumn(
        "end_day", shifted(F.col("start_day"), F.col("quantity") - 5)
    )


def cost_by_month(t: Tables) -> DataFrame:
    """Prorated cost of all campaigns per month, each campaign rounded to cents."""
    shares = prorated(order_campaigns(t), "start_day", "end_day", F.col("cost"), ["o_orderkey"])
    rounded = F.round(F.col("month_cost"), -2).cast("long")
    return shares.groupBy("month").agg(
        F.count(F.lit(1)).alias("campaigns"), F.sum("days").alias("days"), total(rounded).alias("cost")
    )


def offline_cost_by_month(t: Tables) -> DataFrame:
    """Prorated cost of the latest version of each (ticket, cost type), without rounding.

    A ticket is an order, its cost types the return flags, a version a line.
    """
    latest = first_per_key(
        t.lineitem,
        ["l_orderkey", "l_returnflag"],
        [F.col("l_shipdate").desc(), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")],
    )
    start = day("l_shipdate")
    tickets = latest.select(
        "l_returnflag",
        start.alias("start_day"),
        shifted(start, F.col("l_quantity") - 5).alias("end_day"),
        F.coalesce(F.when(is_promo_line(), discount_amount()), F.lit(0)).alias("cost"),
    )
    shares = prorated(tickets, "start_day", "end_day", F.col("cost"), ["l_returnflag"])
    return shares.groupBy("l_returnflag", "month").agg(
        F.count(F.lit(1)).alias("tickets"), (F.sum("month_cost").cast("decimal(28,6)") / TICKS).cast("double").alias("cost")
    )


def campaigns_per_day(t: Tables) -> DataFrame:
    """Campaigns running on each day, through a row per campaign and day."""
    days = order_campaigns(t).select(F.explode(day_series(F.col("start_day"), F.col("end_day"))).alias("day"))
    return days.groupBy("day").agg(F.count(F.lit(1)).alias("campaigns"))


# --- promotions per brand --------------------------------------------------------


def brand_number() -> Column:
    return F.substring("p_brand", 7, 4).cast("int")


def promotions(t: Tables, as_of: dt.date) -> DataFrame:
    """One promotion per brand, with interval and kind.

    Quotas grow with the number of products of the brand; every fifth promotion
    is unlimited, every seventh counts as global, the first is for single use.
    """
    number = brand_number()
    quota = F.when(number == 1, F.lit(1)).otherwise(F.count(F.lit(1)) * 15)
    return (
        t.part.groupBy("p_brand")
        .agg(quota.alias("quantity"))
        .withColumns(
            {
                "start_day": F.date_sub(F.lit(as_of), number * 9),
                "end_day": F.date_add(F.lit(as_of), (number - 6) * 2),
                "is_unlimited": number % 5 == 0,
                "attribution": F.when(number % 7 == 0, "global").otherwise("local"),
            }
        )
    )


def lines_with_orders(t: Tables, as_of: dt.date, lines: DataFrame) -> DataFrame:
    """Lines with their brand and their order before the run date.

    Lines and orders meet on the order first: what is summed per order afterwards
    stays where it is, as rows of an order are together.
    """
    brands = t.part.select("p_partkey", "p_brand")
    orders = t.orders.filter(within_days("o_orderdate", None, as_of - dt.timedelta(days=1)))
    placed = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", day("o_orderdate").alias("order_day"))
    return lines.join(brands, F.col("l_partkey") == F.col("p_partkey")).join(placed, F.col("l_orderkey") == F.col("o_orderkey"))


#: Columns of an order beside its key, which are the same on all its lines.
OF_ORDER = ["o_custkey", "o_orderstatus", "o_orderpriority", "order_day"]


def promoted_orders(t: Tables, as_of: dt.date) -> DataFrame:
    """One row per order and brand before the run date, with cost and value of its promoted lines."""
    lines = t.lineitem.filter(is_promo_line()).select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount")
    return lines_with_orders(t, as_of, lines).groupBy("o_orderkey", "p_brand").agg(
        *[F.any_value(c).alias(c) for c in OF_ORDER], F.sum(discount_amount()).alias("cost"), F.sum(gross()).alias("gmv")
    )


def run_rates(t: Tables, as_of: dt.date) -> DataFrame:
    """Cost per brand and month with the running month projected to its end.

    Looks at the running year and the two before.
    """
    since = minus_months(as_of.replace(month=1, day=1), 24)
    recent = promoted_orders(t, as_of).filter(F.col("order_day") >= since)
    orders = spread_join(recent, first_valid_days(t), "o_custkey")
    new = is_valid() & (F.col("order_day") == F.col("first_valid_day"))
    monthly = orders.groupBy("p_brand", month_start("order_day").alias("month")).agg(
        total(F.col("cost")).alias("cost"),
        F.min("order_day").alias("first_order"),
        F.count(F.lit(1)).alias("orders"),
        F.count_distinct(F.when(new, F.col("o_custkey"))).alias("new_customers"),
    )
    joined = monthly.join(promotions(t, as_of), "p_brand")
    factor = campaign_factor(as_of, F.col("start_day"), F.col("end_day"), F.col("first_order"))
    projected = factor * F.col("cost")
    platform = F.lit(PLATFORM_SHARE_OF_DISCOUNT / 100)
    return joined.select(
        "p_brand", "month", "start_day", "end_day", "orders", "new_customers",
        "cost",
        projected.alias("run_rate"),
        (projected * platform).alias("run_rate_platform"),
        (projected * (1 - platform)).alias("run_rate_seller"),
        F.lit(as_of).alias("run_date"),
    )


def redemption_run_rates(t: Tables, as_of: dt.date) -> DataFrame:
    """Cost per brand and day, beside the month-end value of all redemptions of its code.

    Codes for single use are reported under their type, without dates, and so
    are never projected.
    """
    daily = promoted_orders(t, as_of).groupBy("p_brand", "order_day").agg(
        total(F.col("cost")).alias("cost"), F.count(F.lit(1)).alias("redemptions")
    )
    joined = daily.join(promotions(t, as_of), "p_brand")
    single = F.col("quantity") <= 1
    coded = joined.select(
        F.when(single, "single use").otherwise(F.col("p_brand")).alias("code"),
        "order_day", "redemptions", "cost",
        F.when(~single, F.col("start_day")).alias("start_day"),
        F.when(~single, F.col("end_day")).alias("stop_day"),
    )
    value = redemption_projection(as_of, F.col("cost"), F.col("start_day"), F.col("stop_day"), F.col("order_day"))
    valued = coded.withColumn("projection", value.cast("decimal(18,6)"))
    # Summed per day already: the window holds one row per code and calendar day.
    of_code = F.sum("projection").over(Window.partitionBy("code")).cast("double")
    return valued.select("code", "order_day", "redemptions", "cost", of_code.alias("code_projection"))


def capped_allocation(t: Tables, as_of: dt.date) -> DataFrame:
    """Projected cost per brand, segment and month, held under what is left of the quota.

    The cap of a limited promotion is its remaining quantity times the mean
    value of this month's orders, shared over segments by their orders.
    """
    seen = as_of - dt.timedelta(days=1)
    month0 = F.lit(first_of_month(seen))
    month1 = F.add_months(month0, 1)
    segments = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    orders = promoted_orders(t, as_of).select("p_brand", "o_custkey", "order_day", "cost").join(segments, "o_custkey")
    terms = promotions(t, as_of)

    keys = ["p_brand", "c_mktsegment"]
    monthly = orders.groupBy(*keys, month_start("order_day").alias("month")).agg(
        exact_sum(F.col("cost")).alias("cost"), F.count(F.lit(1)).alias("orders"), F.min("order_day").alias("first_order")
    )
    # The monthly relation has a few rows per brand and segment: as many as months.
    this_month = F.col("month") == month0
    brand, segment = Window.partitionBy("p_brand"), Window.partitionBy(*keys)
    all_orders = F.sum("orders").over(brand)
    orders_before = F.coalesce(F.sum(F.when(F.col("month") < month0, F.col("orders"))).over(brand), F.lit(0))
    mean_value = safe_ratio(
        amount(F.sum(F.when(this_month, F.col("cost"))).over(brand)),
        F.sum(F.when(this_month, F.col("orders"))).over(brand),
    )
    capped = (F.col("start_day") < month1) & (F.col("end_day") >= month0)
    limited = capped & ~F.col("is_unlimited")
    free = (F.col("quantity") <= 1) | F.col("attribution").isin("global", "other") | F.col("is_unlimited")
    factor = F.when(free, open_factor(as_of, F.col("first_order"))).otherwise(
        campaign_factor(as_of, F.col("start_day"), F.col("end_day"), F.col("first_order"))
    )
    cost = amount(F.col("cost"))
    projected = F.when(
        this_month,
        F.when(free, cost * factor).otherwise(
            strict_least(cost * factor, strict_greatest(F.col("segment_cap"), cost))
        ),
    ).otherwise(cost)
    return (
        monthly.join(terms, "p_brand")
        .withColumns(
            {
                "quantity_left": F.when(limited, F.col("quantity") - all_orders),
                "cap": F.when(limited, (F.col("quantity") - orders_before).cast("double") * mean_value),
                "share": F.when(capped, safe_ratio(F.sum("orders").over(segment), all_orders)),
            }
        )
        .withColumn("segment_cap", F.col("share") * F.col("cap"))
        .select(*keys, "month", "orders", "quantity", "quantity_left", "share", "segment_cap", cost.alias("cost"), projected.alias("run_rate"))
    )


# --- before and during -----------------------------------------------------------


def campaigns(t: Tables, first_start: dt.date) -> DataFrame:
    """One campaign per brand, at its own date and of its own length."""
    number = brand_number()
    start = F.date_add(F.lit(first_start), number * 10)
    return t.part.select("p_brand").distinct().select(
        "p_brand", start.alias("start_day"), F.date_add(start, number + 20).alias("end_day"), (number + 20).alias("days")
    )


def before_and_during(t: Tables, as_of: dt.date, first_start: dt.date) -> DataFrame:
    """Promoted orders during each campaign against plain orders in the same span before it.

    One pass over lines and orders sums promoted and plain lines apart, per day; both
    sides start from these sums, which are written once.  So the interval join works
    on days.  The start day belongs to both spans.
    """
    keys = ["p_brand", "o_orderpriority"]
    planned = campaigns(t, first_start)
    running = F.col("order_day").between(F.col("start_day"), F.col("end_day"))
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount")
    per_order = lines_with_orders(t, as_of, lines).withColumn("promoted", is_promo_line()).groupBy("o_orderkey", "p_brand", "promoted").agg(
        *[F.any_value(c).alias(c) for c in OF_ORDER], F.sum(gross()).alias("gmv")
    )
    daily = checkpointed(
        per_order.groupBy(*keys, "promoted", "order_day").agg(
            F.count(F.lit(1)).alias("orders"), count_where(is_failed()).alias("failed"), exact_sum(F.col("gmv")).alias("gmv")
        )
    )
    during = (
        daily.filter("promoted")
        .join(planned, "p_brand")
        .groupBy(*keys, "start_day", "end_day", "days")
        .agg(
            F.coalesce(F.sum(F.when(running, F.col("orders"))), F.lit(0)).alias("orders_during"),
            F.coalesce(F.sum(F.when(running, F.col("failed"))), F.lit(0)).alias("failed_during"),
            F.sum(F.when(running, F.col("gmv"))).alias("gmv_during"),
        )
    )
    plain = daily.filter(~F.col("promoted")).drop("promoted")
    opening = F.date_sub(F.col("start_day"), F.col("days"))
    joined = band_join(during, plain, keys, opening, F.col("start_day"), F.col("order_day"), band=32)
    per_priority = joined.groupBy(*keys, "start_day", "end_day", "days", "orders_during", "failed_during", "gmv_during").agg(
        F.coalesce(F.sum("orders"), F.lit(0)).alias("orders_before"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed_before"),
        F.coalesce(F.sum("gmv"), F.lit(0)).alias("gmv_before"),
    )
    priority = F.col("o_orderpriority")
    return per_priority.groupBy("p_brand", "start_day", "end_day", "days").agg(
        ordered_text(priority, [-F.length(priority), priority], distinct=True).alias("priorities"),
        F.sum("orders_during").alias("orders_during"),
        F.sum("failed_during").alias("failed_during"),
        amount(F.sum("gmv_during")).alias("gmv_during"),
        F.sum("orders_before").alias("orders_before"),
        F.sum("failed_before").alias("failed_before"),
        amount(F.sum("gmv_before")).alias("gmv_before"),
    )


def before_and_during_single_pass(t: Tables, as_of: dt.date, first_start: dt.date) -> DataFrame:
    """The same comparison among promoted orders alone, in one pass of conditional aggregates."""
    orders = promoted_orders(t, as_of).join(campaigns(t, first_start), "p_brand")
    date = F.col("order_day")
    during = date.between(F.col("start_day"), F.col("end_day"))
    before = date.between(F.date_sub("start_day", F.col("days")), F.col("start_day"))
    return orders.groupBy("p_brand", "start_day", "end_day", "days").agg(
        count_where(during).alias("orders_during"),
        count_where(during & is_failed()).alias("failed_during"),
        total(F.when(during, F.col("gmv"))).alias("gmv_during"),
        count_where(before).alias("orders_before"),
        count_where(before & is_failed()).alias("failed_before"),
        total(F.when(before, F.col("gmv"))).alias("gmv_before"),
    )


def performance(t: Tables) -> DataFrame:
    """Promoted orders of each brand at each seller: counts, value and subsidy."""
    lines = t.lineitem.filter(is_promo_line()).select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
    brands = t.part.select("p_partkey", "p_brand")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    # Lines meet their order first, so that summing per order moves nothing.
    met = lines.join(brands, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    placed = met.groupBy("p_brand", "l_suppkey", "o_orderkey").agg(
        *[F.any_value(c).alias(c) for c in ("o_custkey", "o_orderstatus", "o_orderdate")],
        F.sum(gross()).alias("gmv"), F.sum(discount_amount()).alias("cost"),
    )
    orders = spread_join(placed, first_valid_days(t), "o_custkey")
    valid = is_valid()
    share = PLATFORM_SHARE_OF_DISCOUNT
    return orders.groupBy("p_brand", "l_suppkey").agg(
        F.count(F.lit(1)).alias("orders"),
        count_where(valid).alias("valid_orders"),
        count_where(is_failed()).alias("wasted_orders"),
        count_where(valid & (day("o_orderdate") == F.col("first_valid_day"))).alias("first_day_orders"),
        total(F.when(valid, F.col("gmv"))).alias("gmv"),
        total(F.when(valid, F.col("cost") * share), PERCENT_TICKS).alias("platform_subsidy"),
        total(F.when(valid, F.col("cost") * (100 - share)), PERCENT_TICKS).alias("seller_subsidy"),
    )
