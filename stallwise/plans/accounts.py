"""Seller and order sheets: billing, contracts, compliance, deals, tickets, purchase orders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions.dates import day, month_start, within_days
from stallwise.functions.numeric import (
    amount,
    exact_sum,
    money,
    round_to_scale,
    safe_ratio,
    total,
)
from stallwise.operators.aggregates import count_where, per_id_flags
from stallwise.operators.bitmaps import BUCKET, id_sets
from stallwise.operators.joins import spread_join
from stallwise.operators.ranking import first_per_key
from stallwise.operators.unnest import unnest
from stallwise.plans.orders import (
    PERCENT_TICKS,
    PLATFORM_CAUSE,
    PLATFORM_SHARE_OF_DISCOUNT,
    PLATFORM_SHARE_OF_VOUCHER,
    failed_by,
    first_valid_days,
)
from stallwise.sources.tables import (
    Tables,
    discount_amount,
    gross,
    is_failed,
    is_promo_line,
    is_valid,
    net,
    tax_amount,
)


def in_cents(value: Column) -> Column:
    """Amount times a percentage, rounded to cents, as double; none counts as zero."""
    return amount(F.round(F.coalesce(value, F.lit(0)), -4), PERCENT_TICKS)


def billing(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """One row per order of a period with its promotions split between platform and seller."""
    per_order = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(net()).alias("food_value"),
        F.sum(F.when(is_promo_line(), discount_amount())).alias("discount"),
        F.sum(F.when(F.col("l_tax") > 0.06, tax_amount())).alias("voucher"),
    )
    orders = t.orders.filter(within_days("o_orderdate", start, end))
    platform_discount = F.col("discount") * PLATFORM_SHARE_OF_DISCOUNT
    seller_discount = F.col("discount") * (100 - PLATFORM_SHARE_OF_DISCOUNT)
    platform_voucher = F.col("voucher") * PLATFORM_SHARE_OF_VOUCHER
    seller_voucher = F.col("voucher") * (100 - PLATFORM_SHARE_OF_VOUCHER)
    return orders.join(per_order, "o_orderkey", "left").select(
        "o_orderkey", "o_custkey", day("o_orderdate").alias("order_day"), "o_orderpriority",
        is_valid().alias("is_valid"), "o_totalprice",
        amount(F.coalesce("food_value", F.lit(0))).alias("food_value"),
        in_cents(F.col("voucher") * 100).alias("voucher"),
        in_cents(platform_voucher).alias("platform_voucher"),
        in_cents(seller_voucher).alias("seller_voucher"),
        in_cents(F.col("discount") * 100).alias("discount"),
        in_cents(platform_discount).alias("platform_discount"),
        in_cents(seller_discount).alias("seller_discount"),
        amount(
            F.round(F.coalesce(platform_voucher, F.lit(0)), -4) + F.round(F.coalesce(platform_discount, F.lit(0)), -4),
            PERCENT_TICKS,
        ).alias("platform_total"),
    )


def compliance(t: Tables, as_of: dt.date, weeks: int) -> DataFrame:
    """Catalogue, first order and recent trade of every seller, each measured alone before the joins."""
    # Products of a seller are kept as sets, not as one row per pair; a part that is listed twice counts twice.
    sold = id_sets(t.lineitem, ["l_suppkey"], "l_partkey", {"sold": F.lit(True)})
    named = t.part.filter(~F.lower("p_name").like("%widget%")).groupBy("p_partkey").agg(
        F.count(F.lit(1)).alias("entries"), count_where(F.col("p_size") > 10).alias("pictures")
    )
    listed = id_sets(named, ["entries", "pictures"], "p_partkey", {"listed": F.lit(True)})
    both = F.bit_count(F.col("sold").bitwiseAND(F.col("listed"))).cast("long")
    products = (
        spread_join(sold, listed, BUCKET, "inner").select("l_suppkey", "entries", "pictures", both.alias("both"))
        .filter("both > 0")
        .groupBy("l_suppkey")
        .agg(F.sum(F.col("entries") * F.col("both")).alias("products"), F.sum(F.col("pictures") * F.col("both")).alias("with_picture"))
    )
    orders = t.orders.select(
        F.col("o_orderkey").alias("l_orderkey"), day("o_orderdate").alias("order_day"), is_valid().alias("valid"),
    )
    lines = t.lineitem.select("l_suppkey", "l_orderkey", "l_extendedprice", "l_discount")
    # Orders are told apart where they are counted, in the last weeks; all earlier lines of a seller fall into one row.
    late = F.col("order_day") >= as_of - dt.timedelta(weeks=weeks)
    stops = lines.join(orders, "l_orderkey").groupBy("l_suppkey", F.when(late, F.col("l_orderkey")).alias("recent_order")).agg(
        F.min(F.when(F.col("valid"), F.col("order_day"))).alias("first_valid_day"), F.any_value("valid").alias("valid"),
        F.sum(F.when(late, gross())).alias("gmv"), F.sum(F.when(late, net())).alias("gfv"),
    )
    recent = F.col("recent_order").isNotNull()
    trade = stops.groupBy("l_suppkey").agg(
        F.min("first_valid_day").alias("first_valid_day"),
        count_where(recent).alias("gross_orders"),
        count_where(recent & F.col("valid")).alias("valid_orders"),
        count_where(recent & ~F.col("valid")).alias("failed_orders"),
        total(F.when(recent & F.col("valid"), F.col("gmv")).otherwise(0)).alias("gmv"),
        total(F.when(recent & F.col("valid"), F.col("gfv")).otherwise(0)).alias("gfv"),
    )
    sellers = t.supplier.filter(~F.lower("s_name").like("%test%")).select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    joined = sellers.join(products, "l_suppkey", "left").join(trade, "l_suppkey", "left")
    return joined.select(
        "*",
        safe_ratio(F.col("failed_orders"), F.col("gross_orders")).alias("fail_rate"),
        safe_ratio(F.col("gfv"), F.col("valid_orders")).alias("mean_food_value"),
    )


def contracts(t: Tables) -> DataFrame:
    """The standing commission of each seller beside that of its first trial.

    A contract is a line: trials have an end (flag R), standing ones none (flag N).
    """
    tie = [F.col(c) for c in ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]]
    lines = t.lineitem.select("l_suppkey", "l_shipdate", "l_returnflag", "l_discount", *tie)
    trial = first_per_key(lines.filter(F.col("l_returnflag") == "R"), ["l_suppkey"], [F.col("l_shipdate"), *tie])
    standing = first_per_key(lines.filter(F.col("l_returnflag") == "N"), ["l_suppkey"], [F.col("l_shipdate").desc(), *tie])
    products = t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("products"))
    return (
        standing.select("l_suppkey", F.col("l_discount").alias("standing"), day("l_shipdate").alias("since"))
        .join(trial.select("l_suppkey", F.col("l_discount").alias("trial")), "l_suppkey", "left")
        .join(products, "l_suppkey")
        .select("l_suppkey", "since", "products", "standing", F.ifnull("trial", "standing").alias("with_trial"))
    )


def deals_by_category(t: Tables) -> DataFrame:
    """Deals with each category they apply to and its title, where the brand has such a category.

    Category numbers are kept as text in the deal and as numbers in the catalogue.
    """
    size = F.col("p_size")
    deals = t.part.select(
        "p_brand", "p_type", F.array(size.cast("string"), (size + 1).cast("string")).alias("categories")
    )
    listed = unnest(deals, "categories", "category").select("p_brand", "p_type", "category").distinct()
    titles = t.part.groupBy("p_brand", F.col("p_size").alias("number")).agg(F.min("p_name").alias("title"))
    on = (listed["p_brand"] == titles["p_brand"]) & (listed["category"].cast("int") == titles["number"])
    return listed.join(titles, on, "left").select(listed["p_brand"], "p_type", "category", "title")


def idle_products(t: Tables, as_of: dt.date, days: int) -> DataFrame:
    """Orders of the last days of every product, idle ones included, with its value class.

    The class comes from returned sales of all time, else from the price.
    """
    recent = t.orders.filter(within_days("o_orderdate", as_of - dt.timedelta(days=days), as_of)).select(
        F.col("o_orderkey").alias("l_orderkey"), is_valid().alias("valid")
    )
    sold = per_id_flags(
        t.lineitem.select("l_partkey", "l_orderkey").join(recent, "l_orderkey"), ["l_partkey"], "l_orderkey", {"valid": F.col("valid")}
    ).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("orders"), count_where(F.col("valid")).alias("valid_orders"))
    sales = t.lineitem.filter(F.col("l_returnflag") == "R").groupBy("l_partkey").agg(exact_sum(gross()).alias("value"))
    from_sales = F.when(amount(F.col("value")) > 500_000, "A").when(F.col("value").isNotNull(), "B")
    from_price = F.when(F.col("p_retailprice") > 1_000, "C").otherwise("D")
    joined = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice").join(sold, "l_partkey", "left").join(sales, "l_partkey", "left")
    orders, valid = (F.coalesce(c, F.lit(0)) for c in ["orders", "valid_orders"])
    return joined.select(
        "l_partkey", "p_brand", F.ifnull(from_sales, from_price).alias("value_class"),
        orders.alias("orders"), valid.alias("valid_orders"), (orders - valid).alias("failed_orders"),
        safe_ratio(orders - valid, orders).alias("fail_rate"), (orders == 0).alias("is_idle"),
    )


def ticket_periods(t: Tables, as_of: dt.date, months: int) -> DataFrame:
    """The latest version of each ticket, cost type and cost, labelled by its length.

    A ticket is an order, the cost type a return flag; it runs for twice the quantity in days.
    """
    start = day("l_shipdate")
    recent = t.lineitem.filter(F.col("l_shipdate") >= F.lit(as_of).cast("timestamp_ntz") - F.make_ym_interval(months=F.lit(months)))
    latest = first_per_key(
        recent.withColumn("cost", F.col("l_quantity").cast("int").cast("string")),
        ["l_orderkey", "l_returnflag", "cost"],
        [F.col("l_shipdate").desc(), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_extendedprice")],
    )
    end = F.date_add(start, (F.col("l_quantity") * 2).cast("int"))
    length = F.datediff(end, start)
    label = F.when(length <= 30, "1 month").when(length <= 60, "2 months").when(length <= 90, "3 months")
    return latest.select(
        "l_orderkey", "l_returnflag", "cost", F.substring(start.cast("string"), 1, 7).alias("month"), label.alias("period")
    )


def purchase_orders(t: Tables, month: dt.date) -> DataFrame:
    """Orders of a month with their value at the number of digits of the country's currency."""
    digits = F.when(F.col("c_nationkey") < 5, 0).when(F.col("c_nationkey") < 20, 2)
    value = F.coalesce(F.col("gfv"), F.lit(0)).cast("decimal(18,0)") / 10_000
    values = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(net()).alias("gfv"))
    next_month = (month.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
    orders = t.orders.filter(
        within_days("o_orderdate", month, next_month - dt.timedelta(days=1)) & ~F.col("o_orderpriority").like("%NOT%")
    )
    homes = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    joined = orders.join(values, "o_orderkey", "left").join(homes, "o_custkey", "left")
    rounded = round_to_scale(value.cast("decimal(18,4)"), F.coalesce(digits, F.lit(2)))
    return joined.select("o_orderkey", "c_nationkey", rounded.alias("value"), day("o_orderdate").alias("created"), "o_orderstatus")


def platform_failures(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """Orders per seller that the platform failed in a period, and the sum of their distinct values."""
    failed = t.orders.filter(within_days("o_orderdate", start, end) & failed_by(PLATFORM_CAUSE)).select(
        F.col("o_orderkey").alias("l_orderkey"), money("o_totalprice").alias("value")
    )
    stops = t.lineitem.select("l_orderkey", "l_suppkey").distinct()
    return stops.join(failed, "l_orderkey").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("failed_orders"),
        amount(F.sum_distinct("value")).alias("distinct_value"),
        total(F.col("value")).alias("value"),
    )


def keyword_usage(t: Tables, keyword: str) -> DataFrame:
    """Promoted orders of products matching a keyword, per month: orders, customers, new customers."""
    named = t.part.filter(F.lower("p_name").contains(keyword.lower())).select("p_partkey")
    used = (
        t.lineitem.filter(is_promo_line())
        .join(named, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.sum(discount_amount()).alias("cost"))
    )
    orders = spread_join(t.orders.join(used, "o_orderkey"), first_valid_days(t), "o_custkey")
    new = is_valid() & (day("o_orderdate") == F.col("first_valid_day"))
    per_customer = orders.groupBy(month_start("o_orderdate").alias("month"), "o_custkey").agg(
        F.count(F.lit(1)).alias("orders"), count_where(is_failed()).alias("failed"),
        F.bool_or(new).alias("is_new"), F.sum("cost").alias("cost"),
    )
    return per_customer.groupBy("month").agg(
        F.count("o_custkey").alias("customers"), count_where(F.col("is_new") & F.col("o_custkey").isNotNull()).alias("new_customers"),
        F.sum("orders").alias("orders"), F.sum("failed").alias("failed_orders"), total(F.col("cost")).alias("cost"),
    )


def orders_with_products(t: Tables, names: list[str]) -> DataFrame:
    """Completed orders that hold any of the named products, with how many of them."""
    named = t.part.filter(F.col("p_name").isin(names)).select("p_partkey", "p_name")
    lines = t.lineitem.select("l_orderkey", "l_partkey").join(named, F.col("l_partkey") == F.col("p_partkey"))
    held = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("p_name").alias("names")
    )
    return t.orders.filter(is_valid()).join(held, "o_orderkey").select("o_orderkey", "o_custkey", day("o_orderdate").alias("order_day"), "lines", "names")
