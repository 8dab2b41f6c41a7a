"""Customer reports: churn, lapse, migration, growth, first orders, tenure."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.functions.dates import day, minus_months, month_start, within_days
from stallwise.functions.numeric import amount, exact_sum, money, safe_ratio, total
from stallwise.operators.aggregates import count_where, sum_where
from stallwise.operators.joins import having, spread_join, without
from stallwise.operators.ranking import running_by_step
from stallwise.session import checkpointed
from stallwise.sources.tables import Tables, gross, is_failed, is_valid, net, order_values

CHURN_DAYS = 28


def churn_features(t: Tables, as_of: dt.date, months: int) -> DataFrame:
    """Recency, spend and promotion use per customer; churned after 28 days without an order.

    Recency counts all completed orders, the other features those of the last
    months.  Lines are summed per order first, so nothing is counted twice.
    """
    recent = t.orders.filter(within_days("o_orderdate", minus_months(as_of, months), as_of))
    featured = recent.join(order_values(t.lineitem), "o_orderkey", "left")
    features = featured.groupBy("o_custkey").agg(
        count_where(is_valid()).alias("valid_orders"),
        count_where(is_failed()).alias("failed_orders"),
        count_where(F.col("has_promo")).alias("promo_orders"),
        count_where(F.col("has_voucher")).alias("voucher_orders"),
        total(F.when(is_valid(), F.col("gfv"))).alias("spend"),
    )
    last = t.orders.filter(is_valid()).groupBy("o_custkey").agg(F.max(day("o_orderdate")).alias("last_day"))
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment").join(last, "o_custkey")
    idle = F.datediff(F.lit(as_of), F.col("last_day"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return customers.join(features, "o_custkey", "left").select(
        "o_custkey", "c_mktsegment", "last_day", idle.alias("days_idle"),
        *[zero(c) for c in ["valid_orders", "failed_orders", "promo_orders", "voucher_orders"]],
        "spend",
        safe_ratio(F.col("spend"), F.col("valid_orders")).alias("mean_spend"),
        (idle > CHURN_DAYS).alias("is_churned"),
    )


def lapsed(t: Tables, active: tuple[dt.date, dt.date], silent: tuple[dt.date, dt.date], k: int) -> DataFrame:
    """Customers with completed orders in one period and none in the next, the most valuable first."""
    valid = t.orders.filter(is_valid())
    before = valid.filter(within_days("o_orderdate", *active))
    after = valid.filter(within_days("o_orderdate", *silent)).select("o_custkey")
    spent = before.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"), exact_sum(money("o_totalprice")).alias("value"), F.max(day("o_orderdate")).alias("last_day")
    )
    gone = without(spent, after, "o_custkey").join(
        t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey"
    )
    top = gone.orderBy(F.col("value").desc(), "o_custkey").limit(k)
    return top.select("o_custkey", "c_name", "orders", amount(F.col("value")).alias("value"), "last_day")


def migration(
    t: Tables, keyword: str, before: tuple[dt.date, dt.date], after: tuple[dt.date, dt.date], k: int
) -> DataFrame:
    """Where the customers lost by the sellers of a keyword order afterwards.

    Sections: the lost customers' totals before and after, and the sellers they
    use most after.
    """
    period = F.when(within_days("o_orderdate", *before), "Before").when(within_days("o_orderdate", *after), "After")
    orders = (
        t.orders.select("o_orderkey", "o_custkey", is_valid().alias("valid"), period.alias("section"))
        .filter(F.col("section").isNotNull())
    )
    sellers = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("seller"))
    matching = sellers.filter(F.lower("seller").contains(keyword.lower()))
    at = lambda section: F.bool_or(F.col("section") == section)

    # Customers of the keyword before but not after: one pass over its own orders.
    of_keyword = having(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey"), matching, "l_suppkey")
    lost = (
        having(orders.filter("valid"), of_keyword, "o_orderkey")
        .groupBy("o_custkey")
        .agg(at("Before").alias("before"), at("After").alias("after"))
        .filter("before and not after")
    )
    theirs = having(orders, lost, "o_custkey")
    # Both sections start from these rows, which are written once: only the lost customers' orders are left.
    sold = checkpointed(
        t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", gross().alias("gmv"))
        .join(theirs, "o_orderkey")
        .groupBy("section", "o_custkey", "o_orderkey", "valid", "l_suppkey")
        .agg(F.sum("gmv").alias("gmv"))
    )
    totals = (
        sold.groupBy("section", "o_custkey", "o_orderkey", "valid")
        .agg(F.sum("gmv").alias("gmv"))
        .groupBy("section", "o_custkey")
        .agg(
            count_where(F.col("valid")).alias("orders"),
            count_where(~F.col("valid")).alias("failed"),
            sum_where(F.col("valid"), F.col("gmv")).alias("gmv"),
        )
        .groupBy("section")
        .agg(
            count_where(F.col("orders") > 0).alias("customers"),
            F.sum("orders").alias("orders"),
            F.sum("failed").alias("failed"),
            total(F.col("gmv")).alias("gmv"),
        )
        .withColumn("seller", F.lit(None).cast("string"))
    )
    top = (
        sold.filter((F.col("section") == "After") & F.col("valid"))
        .groupBy("l_suppkey", "o_custkey")
        .agg(F.count(F.lit(1)).alias("orders"), F.sum("gmv").alias("gmv"))
        .groupBy("l_suppkey")
        .agg(F.count(F.lit(1)).alias("customers"), F.sum("orders").alias("orders"), total(F.col("gmv")).alias("gmv"))
        .join(sellers, "l_suppkey")
        .orderBy(F.col("orders").desc(), "seller")
        .limit(k)
        .select(
            F.lit("Sellers after").alias("section"), "seller", "customers", "orders",
            F.lit(None).cast("bigint").alias("failed"), "gmv",
        )
    )
    place = F.when(F.col("section") == "Before", 1).when(F.col("section") == "After", 2).otherwise(3)
    return (
        totals.unionByName(top)
        .orderBy(place, F.col("orders").desc(), "seller")
        .select(
            "section", "seller", "customers", "orders", "failed", "gmv",
            safe_ratio(F.col("gmv"), F.col("orders")).alias("mean_value"),
        )
    )


def base_growth(t: Tables) -> DataFrame:
    """New, active and cumulative customers by month and city of the first order.

    The city of an order is that of its seller (the lowest city number if it has
    several).
    """
    cities = t.supplier.select("s_suppkey", "s_nationkey")
    placed = (
        t.lineitem.select("l_orderkey", "l_suppkey")
        .join(cities, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.min("s_nationkey").alias("city"))
    )
    orders = t.orders.filter(is_valid()).select("o_orderkey", "o_custkey", "o_orderdate").join(placed, "o_orderkey")
    monthly = orders.groupBy("o_custkey", month_start("o_orderdate").alias("month")).agg(
        F.min(F.struct("o_orderdate", "o_orderkey", "city")).alias("earliest")
    )
    # One row per customer and month from here on, so a window may hold all of a customer.
    first = F.min("earliest").over(Window.partitionBy("o_custkey"))
    dated = monthly.select("month", first["city"].alias("city"), month_start(first["o_orderdate"]).alias("first_month"))
    cells = dated.groupBy("month", "city").agg(
        count_where(F.col("month") == F.col("first_month")).alias("new_customers"),
        F.count(F.lit(1)).alias("active_customers"),
    )
    so_far = Window.partitionBy("city").orderBy("month")
    return cells.withColumn("customers_so_far", F.sum("new_customers").over(so_far))


def first_order_flags(t: Tables) -> DataFrame:
    """Completed orders per day that were the customer's first, overall and at the seller."""
    orders = t.orders.filter(is_valid()).select("o_orderkey", "o_custkey", day("o_orderdate").alias("order_day"))
    lines = t.lineitem.select("l_orderkey", "l_suppkey")
    # Lines meet their order first, so that making them distinct moves nothing; written once, as it is looked at twice.
    sold = checkpointed(
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_orderkey", "l_suppkey")
        .agg(F.any_value("o_custkey").alias("o_custkey"), F.any_value("order_day").alias("order_day"))
    )
    first = orders.groupBy("o_custkey").agg(F.min("order_day").alias("first_day"))
    first_at_seller = sold.groupBy("o_custkey", "l_suppkey").agg(F.min("order_day").alias("first_seller_day"))
    per_order = (
        spread_join(sold, first_at_seller, ["o_custkey", "l_suppkey"])
        .groupBy("o_orderkey", "order_day")
        .agg(
            F.max("o_custkey").alias("o_custkey"),
            F.bool_or(F.col("order_day") <= F.col("first_seller_day")).alias("new_to_seller"),
        )
    )
    return spread_join(per_order, first, "o_custkey").groupBy("order_day").agg(
        F.count(F.lit(1)).alias("orders"),
        count_where(F.col("order_day") <= F.col("first_day")).alias("new_to_platform"),
        count_where(F.col("new_to_seller")).alias("new_to_seller"),
    )


def tenure(on: Column, since: Column) -> Column:
    """Age class of a partner on a day."""
    return (
        F.when(on < F.date_add(since, 30), "0-30 days")
        .when(on < F.date_add(since, 60), "31-60 days")
        .when(on < F.date_add(since, 90), "61-90 days")
        .otherwise("90+ days")
    )


def early_tenure(on: Column, since: Column) -> Column:
    """Age class of a new courier; NULL once past fifteen days."""
    return F.when(on < F.date_add(since, 7), "0-7 days").when(on < F.date_add(since, 15), "0-15 days")


def daily_sales(t: Tables) -> DataFrame:
    """Lines and value per seller and day of shipment."""
    return t.lineitem.groupBy("l_suppkey", day("l_shipdate").alias("day")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(net()).alias("value")
    )


def sales_by_tenure(t: Tables) -> DataFrame:
    """Days, lines and value of sellers by their age since the first shipment."""
    # Summed per day first: the window holds one row per seller and calendar day.
    aged = daily_sales(t).withColumn("first_day", F.min("day").over(Window.partitionBy("l_suppkey")))
    return aged.groupBy("l_suppkey", tenure(F.col("day"), F.col("first_day")).alias("tenure")).agg(
        F.count(F.lit(1)).alias("days"), F.sum("lines").alias("lines"), total(F.col("value")).alias("value")
    )


def early_sales(t: Tables) -> DataFrame:
    """Running lines and hours of each customer's courier days, within the first two age classes.

    The courier of an order is known by its customer here: one row per customer
    and day of order.
    """
    orders = t.orders.select("o_orderkey", "o_custkey", day("o_orderdate").alias("day"))
    hours = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(money("l_quantity")).alias("hours")
    )
    worked = orders.join(hours, "o_orderkey", "left").groupBy("o_custkey", "day").agg(
        F.sum("lines").alias("lines"), F.sum("hours").alias("hours")
    )
    # One row per customer and calendar day, so a window may hold all of a customer.
    first = F.min("day").over(Window.partitionBy("o_custkey"))
    labelled = worked.withColumn("tenure", early_tenure(F.col("day"), first)).filter(
        F.col("tenure").isNotNull() & F.col("lines").isNotNull()
    )
    running = running_by_step(labelled, ["o_custkey", "tenure"], "day", lines=F.sum("lines"), hours=F.sum("hours"))
    return running.select("o_custkey", "tenure", "day", "lines", amount(F.col("hours")).alias("hours"))
