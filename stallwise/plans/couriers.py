"""Courier reports.  A seller stands for the courier, a line for a delivery or payment."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions.dates import day, iso_week_label, month_start, numbered_weekday, within_days
from stallwise.functions.numeric import TICKS, amount, cents, exact_sum, money, percent, safe_ratio, total
from stallwise.operators.aggregates import count_where, sum_where
from stallwise.operators.joins import having
from stallwise.plans.orders import delivery_fee
from stallwise.sources.tables import Tables, gross

COURIER_DAY = ["courier", "work_day"]

# The parts of a day's pay, in the order they are reported.
PARTS = ["per_hour", "per_delivery", "fallback", "adjustment", "bonus"]


def pay_part() -> Column:
    """Which part of the pay a line belongs to; base pay without a rule is the fallback."""
    return (
        F.when(F.col("l_returnflag") == "R", "adjustment")
        .when(F.col("l_returnflag") == "A", "bonus")
        .when(F.col("l_discount") == 0, "fallback")
        .when(F.col("l_linestatus") == "O", "per_hour")
        .otherwise("per_delivery")
    )


def courier_days(t: Tables) -> DataFrame:
    """Pay parts, hours and deliveries per courier and day.

    The payment streams share their key, so they are stacked under a part name
    and pivoted by one conditional aggregate: one shuffle, where joining a table
    per stream would take one each.  Hours belong to the base stream.
    """
    base = F.col("l_returnflag") == "N"
    return t.lineitem.groupBy(F.col("l_suppkey").alias("courier"), day("l_shipdate").alias("work_day")).agg(
        *[sum_where(pay_part() == part, gross()).alias(part) for part in PARTS],
        sum_where(base, money("l_quantity")).alias("hours"),
        count_where(base).alias("base_payments"),
        F.count_distinct("l_orderkey").alias("deliveries"),
    )


def earnings(t: Tables) -> DataFrame:
    """Pay per courier and day with base pay, all parts and their sum; other days are left out."""
    days = courier_days(t).filter(F.col("base_payments") > 0)
    whole = sum((F.coalesce(F.col(p), F.lit(0)) for p in PARTS[1:]), F.coalesce(F.col(PARTS[0]), F.lit(0)))
    return days.select(
        *COURIER_DAY, *[amount(F.col(p)).alias(p) for p in PARTS],
        amount(F.col("hours")).alias("hours"), "deliveries", amount(whole).alias("total"),
    )


# --- earnings from several streams -------------------------------------------------

# How the streams are named in the report, and the one that a day must have.
STREAMS = ["per_hour", "per_delivery", "fallback", "scoring", "special", "tips"]
BASIC = STREAMS[:3]
SPECIAL_FEE = 2_500  # ticks, for each special payment


def basic_stream(t: Tables, first: dt.date, last: dt.date) -> DataFrame:
    """Base pay by rule type, from the lines of a courier."""
    lines = t.lineitem.filter(within_days("l_shipdate", first, last) & (F.col("l_returnflag") == "N"))
    return lines.select(
        F.col("l_suppkey").alias("courier"), day("l_shipdate").alias("work_day"), pay_part().alias("stream"), gross().alias("ticks")
    )


def scoring_stream(t: Tables, first: dt.date, last: dt.date) -> DataFrame:
    """Scoring pay, from the orders a courier was scored on: a hundredth of their value."""
    scored = t.orders.filter(within_days("o_orderdate", first, last) & (F.col("o_orderstatus") == "F"))
    return scored.select(
        courier_of_order().alias("courier"), day("o_orderdate").alias("work_day"), F.lit("scoring").alias("stream"),
        cents("o_totalprice").alias("ticks"),
    )


def hit_stream(t: Tables, kind: str, stream: str, ticks: Column, years: int) -> DataFrame:
    """Payments made in the app, from its hits; the days of the hits are moved into the years of the orders."""
    return t.events.filter(F.col("event_type") == kind).select(
        F.col("user_id").alias("courier"), F.to_date(F.col("ts") - F.make_ym_interval(years=F.lit(years))).alias("work_day"),
        F.lit(stream).alias("stream"), ticks.alias("ticks"),
    )


def courier_of_order() -> Column:
    return F.col("o_custkey") % 100


def work_stream(t: Tables, first: dt.date, last: dt.date) -> DataFrame:
    """Deliveries, hours and kilometres of each courier and day, from the orders they took."""
    completed = F.col("o_orderstatus") != "P"
    return t.orders.filter(within_days("o_orderdate", first, last)).groupBy(courier_of_order().alias("courier"), day("o_orderdate").alias("work_day")).agg(
        count_where(completed).alias("deliveries"),
        F.count(F.lit(1)).alias("_orders"),
        exact_sum(F.when(completed, cents("o_totalprice"))).alias("_metres"),
    )


def earnings_of_streams(t: Tables, first: dt.date, last: dt.date) -> DataFrame:
    """What each courier earned in a span of days: every stream of pay, and the work it was for.

    The streams come from different tables.  Each is brought to courier, day, name
    and amount, they are stacked, and one aggregate pivots all of them: a join per
    stream would move the days once for each.  Days without base pay are left out
    with all their streams, as the reports start from base pay; amounts are summed
    per day first, as a tip counts only on a day that counts.
    """
    streams = [
        basic_stream(t, first, last), scoring_stream(t, first, last),
        hit_stream(t, "signup", "special", F.lit(SPECIAL_FEE).cast("long"), years=23),
        hit_stream(t, "purchase", "tips", money("value"), years=23),
    ]
    stacked = reduce(DataFrame.unionByName, [s.filter(F.col("work_day").between(first, last)) for s in streams])
    paid = stacked.groupBy(*COURIER_DAY).agg(
        *[F.sum(F.when(F.col("stream") == name, F.col("ticks"))).alias(name) for name in STREAMS]
    )
    paid = paid.filter(reduce(lambda a, b: a | b, [F.col(name).isNotNull() for name in BASIC]))
    days = paid.join(work_stream(t, first, last), COURIER_DAY, "left")
    whole = sum((F.coalesce(F.col(name), F.lit(0)) for name in STREAMS[1:]), F.coalesce(F.col(STREAMS[0]), F.lit(0)))
    zero = lambda value: F.coalesce(value, F.lit(0.0))
    per_courier = days.groupBy("courier").agg(
        total(whole).alias("total"),
        *[zero(total(F.col(name))).alias(name) for name in STREAMS],
        F.count(F.lit(1)).alias("days"),
        F.coalesce(F.sum("deliveries"), F.lit(0)).alias("deliveries"),
        zero(total(F.col("_orders") * (TICKS // 2))).alias("hours"),
        zero(total(F.col("_metres").cast("long"))).alias("km"),
    )
    cities = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("s_suppkey").alias("courier"), F.col("n_name").alias("city")
    )
    return per_courier.join(cities, "courier", "left").select("courier", "city", "total", *STREAMS, "days", "deliveries", "hours", "km")


def hours_class(hours: Column) -> Column:
    """Class of mean hours per day; unknown hours fall into the last one."""
    return (
        F.when(hours <= 10, "0-10")
        .when(hours <= 20, "10-20")
        .when(hours <= 30, "20-30")
        .when(hours <= 40, "30-40")
        .otherwise("over 40")
    )


def couriers_by_hours(t: Tables) -> DataFrame:
    """Couriers and hours per month and class of mean hours per day of work."""
    monthly = courier_days(t).groupBy("courier", month_start("work_day").alias("month")).agg(
        F.sum("hours").alias("hours"), F.count(F.lit(1)).alias("days")
    )
    per_day = safe_ratio(amount(F.col("hours")), F.col("days"))
    return monthly.groupBy("month", hours_class(per_day).alias("hours_per_day")).agg(
        F.count(F.lit(1)).alias("couriers"), total(F.col("hours")).alias("hours")
    )


def latest_contracts(t: Tables) -> DataFrame:
    """The lines of each courier's last day: found by its date, ties are kept."""
    last = t.lineitem.groupBy("l_suppkey").agg(F.max("l_shipdate").alias("l_shipdate"))
    lines = t.lineitem.select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return having(lines, last, ["l_suppkey", "l_shipdate"]).withColumn("l_shipdate", day("l_shipdate"))


def daily_activity(t: Tables) -> DataFrame:
    """Deliveries by city and day, single and stacked, beside the hours booked there.

    A delivery is stacked if its order has several lines with the courier that day.
    """
    cities = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("city")
    )
    lines = t.lineitem.select(
        "l_suppkey", "l_orderkey", day("l_shipdate").alias("work_day"), "l_quantity", "l_returnflag", "l_tax"
    )
    # One row per courier, day and order; both daily aggregates start from it.
    stops = lines.groupBy("l_suppkey", "work_day", "l_orderkey").agg(
        F.count(F.lit(1)).alias("parcels"),
        F.max("l_tax").alias("late"),
        sum_where(F.col("l_returnflag") == "N", money("l_quantity")).alias("hours"),
    )
    stacked = F.col("parcels") > 1
    per_courier = stops.groupBy("l_suppkey", "work_day").agg(
        F.count(F.lit(1)).alias("deliveries"),
        count_where(stacked).alias("stacked"),
        count_where(stacked & (F.col("late") > 0.05)).alias("stacked_late"),
        count_where(~stacked & (F.col("late") > 0.05)).alias("single_late"),
        F.sum("hours").alias("hours"),
    )
    per_city = per_courier.join(cities, "l_suppkey").groupBy("city", "work_day").agg(
        F.sum("deliveries").alias("deliveries"),
        F.count(F.lit(1)).alias("active_couriers"),
        F.sum("stacked").alias("stacked"),
        F.sum("stacked_late").alias("stacked_late"),
        F.sum("single_late").alias("single_late"),
        count_where(F.col("hours").isNotNull()).alias("booked_couriers"),
        total(F.col("hours")).alias("booked_hours"),
    )
    return per_city.withColumn("deliveries_per_hour", safe_ratio(F.col("deliveries"), F.col("booked_hours")))


def availability(t: Tables, as_of: dt.date, days: int) -> DataFrame:
    """Share of the open seconds a seller was closed in the last days; sellers without any stay."""
    quantity = money("l_quantity")
    seconds = quantity * 3600
    recent = t.lineitem.filter(within_days("l_shipdate", as_of - dt.timedelta(days=days), as_of))
    summed = recent.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        total(seconds).alias("open_seconds"),
        exact_sum(seconds * percent("l_tax")).alias("unavailable"),
        exact_sum(F.when(F.col("l_returnflag") == "R", quantity * 60 * 100).otherwise(0)).alias("special"),
    )
    closed = amount(F.col("unavailable") + F.col("special"), TICKS * 100)
    return t.supplier.select("s_suppkey", "s_name").join(summed, "s_suppkey", "left").select(
        "s_suppkey", "s_name", "open_seconds", closed.alias("closed_seconds"), safe_ratio(closed, F.col("open_seconds")).alias("closed_share"),
    )


def fees_by_weekday(t: Tables, as_of: dt.date, months: int) -> DataFrame:
    """Delivery fees per week, weekday and seller: mean distance per order first, then its fee.

    Routes are the quantities of the order's lines, those above the limit
    replaced by the straight line; priority urgent marks device deliveries.
    """
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_ym_interval(months=F.lit(months))
    orders = t.orders.filter(F.col("o_orderdate") >= since).select("o_orderkey", "o_orderpriority", day("o_orderdate").alias("date"))
    route = F.when(F.col("l_quantity") > 25, F.col("l_quantity") * 4 / 5).otherwise(F.col("l_quantity"))
    lines = t.lineitem.select("l_suppkey", "l_orderkey", "l_quantity", "l_tax")
    # Lines meet their order first, so that summing per order moves nothing.
    stops = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", "o_orderkey").agg(
        *[F.any_value(c).alias(c) for c in ("o_orderpriority", "date")],
        total(money(route)).alias("distance"), F.count(F.lit(1)).alias("parcels"), F.max("l_tax").alias("booked"),
    )
    mean_km = F.col("distance") / F.col("parcels")
    fee = delivery_fee(F.col("o_orderpriority") == "1-URGENT", mean_km, mean_km, money("booked"))
    return stops.groupBy(
        F.left(F.col("date").cast("string"), F.lit(7)).alias("month"),
        iso_week_label(F.col("date")).alias("week"),
        numbered_weekday(F.col("date")).alias("weekday"),
        "l_suppkey",
    ).agg(
        total(fee).alias("fees"), F.count(F.lit(1)).alias("orders"), safe_ratio(total(fee), F.count(F.lit(1))).alias("mean_fee"),
    )


def monthly_work(t: Tables) -> DataFrame:
    """Hours, shifts, deliveries and kilometres of each courier per month."""
    seconds, metres = money("l_quantity") * 36, money("l_quantity") * 100
    return t.lineitem.groupBy(
        F.col("l_suppkey").alias("courier"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")
    ).agg(
        (total(seconds) / 3600).alias("hours"),
        F.count_distinct(day("l_shipdate")).alias("shifts"),
        count_where(F.col("l_returnflag") != "R").alias("completed"),
        total(metres).alias("pickup_metres"),
        total(metres * 2).alias("dropoff_metres"),
        (total(metres * 3) / 1000).alias("total_km"),
    )


def shift_creation(t: Tables) -> DataFrame:
    """Shifts per day, courier and city: made by the courier or by automation (status O)."""
    cities = t.nation.select("n_nationkey", F.col("n_name").alias("city"))
    sellers = t.supplier.select("s_suppkey", "s_nationkey")
    created = t.lineitem.groupBy("l_suppkey", day("l_shipdate").alias("work_day")).agg(
        F.count_distinct("l_orderkey").alias("shifts"),
        count_where(F.col("l_linestatus") != "O").alias("own"),
        count_where(F.col("l_linestatus") == "O").alias("automation"),
    )
    placed = created.join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(
        cities, F.col("s_nationkey") == F.col("n_nationkey"), "left"
    )
    return placed.select("work_day", F.col("l_suppkey").alias("courier"), "city", "shifts", "own", "automation")
