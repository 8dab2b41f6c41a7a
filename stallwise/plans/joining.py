"""Joins by key, by computed key, by date, and joins that only test for a partner."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions.dates import day, month_start, within_days
from stallwise.functions.numeric import TICKS, amount, exact_sum, money, safe_ratio, total
from stallwise.operators.joins import band_join, having, left_join_where
from stallwise.sources.tables import Tables, discount_amount, gross, net


def local_sales(t: Tables) -> DataFrame:
    """Sales where seller and customer are of the same city (two-part key)."""
    buyers = t.orders.select("o_orderkey", "o_custkey").join(
        t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")
    )
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice")
    sold = lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
    local = sold.join(
        t.supplier, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))
    )
    return local.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("lines"), total(gross()).alias("value"))


def star(t: Tables) -> DataFrame:
    """Sales by country, segment and product type through six dimensions."""
    sellers = (
        t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select("s_suppkey", "r_name")
    )
    buyers = t.orders.select("o_orderkey", "o_custkey").join(
        t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left"
    )
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
    joined = (
        lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"), "left")
        .join(sellers, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    )
    return joined.groupBy("r_name", "c_mktsegment", "p_type").agg(
        F.count(F.lit(1)).alias("lines"), total(gross()).alias("gmv"), total(net()).alias("gfv")
    )


def recent_sales_of_all_products(t: Tables, as_of: dt.date, days: int) -> DataFrame:
    """Every product with its lines of the last days, if there are several; other products stay without.

    Date and number belong to the join, and no product is lost by them.  Lines
    are summed per product before they meet the products.
    """
    recent = t.orders.filter(within_days("o_orderdate", as_of - dt.timedelta(days=days), as_of)).select("o_orderkey")
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity")
    sold = (
        lines.join(recent, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(F.count(F.lit(1)).alias("lines"), total(money("l_quantity")).alias("quantity"))
    )
    products = t.part.select("p_partkey", "p_brand")
    joined = left_join_where(products, sold, "p_partkey", F.col("lines") > 1)
    return joined.select("p_partkey", "p_brand", F.coalesce("lines", F.lit(0)).alias("lines"), "quantity")


def orders_of_segment_customers(t: Tables, segment: str, min_balance: int) -> DataFrame:
    """Orders of the customers named by a subquery."""
    chosen = t.customer.filter((F.col("c_mktsegment") == segment) & (F.col("c_acctbal") >= min_balance))
    orders = having(t.orders, chosen.select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    return orders.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"), total(money("o_totalprice")).alias("value")
    )


# Which channel each segment is budgeted under, and its share in percent.
SEGMENT_CHANNELS = [
    ("automobile", "Partners", "20"),
    ("building", "Corporate", "35"),
    ("furniture", "Retail", "50"),
    ("household", "Retail", "60"),
]


def channel_mapping(t: Tables) -> DataFrame:
    """The small mapping sheet, with keys and numbers kept as text.

    Written as VALUES, so that the optimizer knows how small it is.
    """
    rows = ", ".join(f"('{segment}', '{channel}', '{share}')" for segment, channel, share in SEGMENT_CHANNELS)
    return t.spark.sql(f"SELECT * FROM VALUES {rows} AS mapping(segment, channel, share)")


def channel_budget(t: Tables) -> DataFrame:
    """Order value per channel: the key is folded to lower case, the share cast from text."""
    customers = t.customer.select("c_custkey", F.lower("c_mktsegment").alias("segment"))
    mapped = customers.join(channel_mapping(t), "segment", "left")
    orders = t.orders.select("o_custkey", "o_totalprice", F.replace("o_orderpriority", F.lit("-"), F.lit("_")).alias("priority"))
    joined = orders.join(mapped, F.col("o_custkey") == F.col("c_custkey"))
    share = F.coalesce(F.col("share").cast("int"), F.lit(100))
    return joined.groupBy(F.coalesce("channel", F.lit("Others")).alias("channel"), "priority").agg(
        F.count(F.lit(1)).alias("orders"),
        total(money("o_totalprice") * share, TICKS * 100).alias("budgeted"),
    )


def urgent_orders_in_opening_spans(t: Tables) -> DataFrame:
    """Every seller's opening span with the urgent orders of its city on each day of it; spans without any stay."""
    opens = F.date_add(F.lit(dt.date(1998, 1, 1)), (F.col("s_suppkey") % 400).cast("int"))
    spans = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("nation"), opens.alias("opens"))
    spans = spans.withColumn("closes", F.date_add("opens", (F.col("s_suppkey") % 90).cast("int")))
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT").select("o_custkey", day("o_orderdate").alias("order_day"))
    customers = t.customer.select("c_custkey", F.col("c_nationkey").alias("nation"))
    sold = urgent.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("nation", "order_day").agg(
        F.count(F.lit(1)).alias("orders")
    )
    met = band_join(spans, sold, ["nation"], F.col("opens"), F.col("closes"), F.col("order_day"), band=16)
    return met.select("s_suppkey", "opens", "closes", "order_day", "orders")


def exchange_rates(t: Tables) -> DataFrame:
    """Rate per city and month of the sales: a rule stands in for the published rates."""
    bounds = t.lineitem.agg(F.struct(month_start(F.min("l_shipdate")).alias("first"), month_start(F.max("l_shipdate")).alias("last")).alias("bounds"))
    bounds = bounds.scalar()  # one query, used twice
    months = F.sequence(bounds["first"], bounds["last"], F.expr("INTERVAL 1 MONTH"))
    rate = (100 + F.col("n_nationkey") * 3 + F.month("rate_month")).cast("decimal(9,2)") / 100
    return t.nation.select("n_nationkey", F.explode(months).alias("rate_month")).withColumn(
        "rate", rate.cast("decimal(9,4)")
    )


def converted_cost(refunded: Column, refund: Column, amount: Column, rate: Column) -> Column:
    """Cost in the common currency; a refund counts with its own amount and sign."""
    return F.when(refunded, safe_ratio(refund, rate)).otherwise(safe_ratio(-amount, rate))


def sales_in_common_currency(t: Tables) -> DataFrame:
    """Value per city and month at the month's rate, refunds overriding the discount.

    Amounts are summed per (city, month, refund) before the rate is looked up:
    the rate is constant there, so the conversion is done once per group.
    """
    sellers = t.supplier.select("s_suppkey", "s_nationkey")
    refunded = F.col("l_returnflag") == "R"
    summed = (
        t.lineitem.join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", month_start("l_shipdate").alias("month"), refunded.alias("refunded"))
        .agg(exact_sum(gross()).alias("goods"), exact_sum(discount_amount()).alias("discount"))
    )
    rates = exchange_rates(t)
    on = (summed["s_nationkey"] == rates["n_nationkey"]) & (summed["month"] == rates["rate_month"])
    cost = converted_cost(F.col("refunded"), amount(F.col("goods")), amount(F.col("discount")), F.col("rate"))
    return summed.join(rates, on, "left").select("s_nationkey", "month", "refunded", cost.alias("cost"))
