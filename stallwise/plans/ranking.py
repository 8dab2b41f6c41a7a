"""First, latest, top and running values; global top-k; unions of report sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.functions.dates import day, month_start
from stallwise.functions.numeric import amount, exact_sum, mean, money, total
from stallwise.operators.aggregates import count_where, with_group_totals
from stallwise.operators.pieces import numbered_by_range
from stallwise.operators.ranking import (
    first_per_key,
    pair_by_rank,
    running_by_step,
    top_per_key,
    with_first_flag,
    with_running,
)
from stallwise.sources.tables import Tables, gross, is_valid


def first_orders(t: Tables) -> DataFrame:
    """The earliest order of each customer, with a flag whether it was completed."""
    first = first_per_key(t.orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return first.select("o_custkey", "o_orderkey", day("o_orderdate").alias("first_day"), is_valid().alias("was_valid"))


def orders_marked_first(t: Tables) -> DataFrame:
    """Every order, marked whether it is the first of its customer at its priority."""
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    marked = with_first_flag(orders, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"], "is_first")
    return marked.select("o_orderkey", "o_custkey", "o_orderpriority", "is_first")


def latest_turns(t: Tables) -> DataFrame:
    """The latest state of each case and role."""
    latest = first_per_key(
        t.conversations, ["conv_id", "role"], [F.col("turn").desc(), F.length("text").desc(), F.col("text")]
    )
    return latest.select("conv_id", "role", "turn", F.length("text").alias("length"))


def paired_orders(t: Tables) -> DataFrame:
    """The n-th urgent order of a customer beside the n-th low-priority one."""
    order = [F.col("o_orderdate"), F.col("o_orderkey")]

    def ranked(priority: str, key: str) -> DataFrame:
        chosen = t.orders.filter(F.col("o_orderpriority") == priority).select("o_custkey", "o_orderkey", "o_orderdate")
        return numbered_by_range(chosen, ["o_custkey"], order, "place").select(
            "o_custkey", "place", F.col("o_orderkey").alias(key)
        )

    return pair_by_rank(ranked("1-URGENT", "urgent_order"), ranked("5-LOW", "low_order"), ["o_custkey"], "place")


def top_sellers_per_city(t: Tables, n: int) -> DataFrame:
    """The best sellers of each city by value."""
    value = t.lineitem.groupBy("l_suppkey").agg(exact_sum(gross()).alias("value"))
    sellers = t.supplier.select("s_suppkey", "s_nationkey").join(value, F.col("s_suppkey") == F.col("l_suppkey"))
    top = top_per_key(sellers, ["s_nationkey"], [F.col("value").desc(), F.col("s_suppkey")], n, rank="place")
    return top.select("s_nationkey", "place", "s_suppkey", amount(F.col("value")).alias("value"))


def lines_with_order_total(t: Tables) -> DataFrame:
    """Each line beside the value and number of lines of its order."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", gross().alias("value"))
    beside = with_group_totals(lines, ["l_orderkey"], order_value=exact_sum(F.col("value")), order_lines=F.count(F.lit(1)))
    return beside.select(
        "l_orderkey", "l_linenumber", "l_partkey", amount(F.col("value")).alias("value"),
        amount(F.col("order_value")).alias("order_value"), "order_lines",
    )


def running_value_per_segment(t: Tables) -> DataFrame:
    """Value so far per segment by day; orders of one day share it."""
    customers = t.customer.select("c_custkey", "c_mktsegment")
    orders = t.orders.select("o_custkey", "o_totalprice", day("o_orderdate").alias("day"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    running = running_by_step(joined, ["c_mktsegment"], "day", so_far=exact_sum(money("o_totalprice")))
    return running.select("c_mktsegment", "day", amount(F.col("so_far")).alias("so_far"))


def running_count_in_month(t: Tables) -> DataFrame:
    """Each order beside the number of orders of its month up to its day."""
    orders = t.orders.select("o_orderkey", day("o_orderdate").alias("day"), month_start("o_orderdate").alias("month"))
    return with_running(orders, ["month"], "day", orders_so_far=F.count("o_orderkey"))


def orders_against_customer_mean(t: Tables) -> DataFrame:
    """Each order beside the mean value of the customer's completed orders."""
    value = money("o_totalprice")
    beside = with_group_totals(
        t.orders, ["o_custkey"], mean_valid=mean(F.when(is_valid(), value)), valid_orders=count_where(is_valid())
    )
    return beside.select("o_orderkey", "o_custkey", "o_totalprice", "mean_valid", "valid_orders")


def most_delayed_lines(t: Tables, k: int) -> DataFrame:
    """The lines shipped longest after their order."""
    orders = t.orders.select("o_orderkey", "o_orderdate")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    delay = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    ranked = joined.withColumn("delay_days", delay).orderBy(
        F.col("delay_days").desc(), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    return ranked.limit(k).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "delay_days")


def ordered_and_shipped(t: Tables) -> DataFrame:
    """Orders and shipments per month: each fact padded with zeros for the other, then summed."""
    zero = F.lit(0).cast("bigint")
    ordered = t.orders.groupBy(month_start("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("orders"))
    shipped = t.lineitem.groupBy(month_start("l_shipdate").alias("month")).agg(F.count(F.lit(1)).alias("shipments"))
    both = ordered.withColumn("shipments", zero).unionByName(shipped.withColumn("orders", zero))
    return both.groupBy("month").agg(F.sum("orders").alias("orders"), F.sum("shipments").alias("shipments"))


def customers_and_sellers(t: Tables) -> DataFrame:
    """Two sections of one report; measures a section lacks are NULL."""
    customers = t.customer.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("customers"), total(money("c_acctbal")).alias("customer_balance")
    )
    sellers = t.supplier.groupBy("s_nationkey").agg(
        F.count(F.lit(1)).alias("sellers"), total(money("s_acctbal")).alias("seller_balance")
    )
    none = lambda kind: F.lit(None).cast(kind)
    first = customers.select(
        F.lit("customers").alias("section"), F.col("c_nationkey").alias("city"), F.col("customers").alias("members"),
        "customer_balance", none("double").alias("seller_balance"),
    )
    second = sellers.select(
        F.lit("sellers").alias("section"), F.col("s_nationkey").alias("city"), F.col("sellers").alias("members"),
        none("double").alias("customer_balance"), "seller_balance",
    )
    return first.unionByName(second)
