"""Aggregates: conditional, distinct, pivoted, string and ratio forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.functions.dates import day, month_start, sunday_week
from stallwise.functions.numeric import amount, mean, money, safe_ratio, total
from stallwise.operators.aggregates import (
    count_where,
    ordered_text,
    per_id_flags,
    repeated_keys,
)
from stallwise.operators.bitmaps import id_sets, sizes, united
from stallwise.operators.joins import spread_join
from stallwise.operators.texts import joined_text
from stallwise.session import checkpointed
from stallwise.sources.tables import Tables, gross, is_failed, is_promo_line, is_valid, net


def line_summary(t: Tables) -> DataFrame:
    """Sum, mean, extremes and counts of the lines per flag and status."""
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        total(money("l_quantity")).alias("sum_qty"),
        total(gross()).alias("sum_gmv"),
        total(net()).alias("sum_gfv"),
        mean(money("l_quantity")).alias("avg_qty"),
        mean(gross()).alias("avg_price"),
        F.min("l_extendedprice").alias("min_price"),
        F.max("l_extendedprice").alias("max_price"),
        F.count(F.lit(1)).alias("lines"),
        F.count(F.when(is_promo_line(), F.lit(1))).alias("promo_lines"),
    )


def distinct_counts_by_month(t: Tables) -> DataFrame:
    """Several distinct counts, plain and conditional, per order month.

    Customers are counted from the orders alone.  Sellers, and products where they
    are promoted, become sets of ids per month, both kinds in one pass, instead of a
    row per id or a copy of every line for each count.
    """
    valid_lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey", "l_discount")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", month_start("o_orderdate").alias("month"))
    joined = orders.join(valid_lines, F.col("o_orderkey") == F.col("l_orderkey"))
    named = lambda kind, key, flag: F.struct(F.lit(kind).alias("kind"), key.alias("id"), flag.alias("flag"))
    promoted = F.when(is_promo_line(), F.col("l_partkey"))
    both = F.array(named("seller", F.col("l_suppkey"), is_failed()), named("product", promoted, F.lit(True)))
    listed = joined.select("month", F.explode(both).alias("e")).select("month", "e.kind", "e.id", "e.flag")
    sets = id_sets(listed, ["month", "kind"], "id", {"every": F.lit(True), "flagged": F.col("flag")})
    ids = sizes(sets, ["month", "kind"], ["every", "flagged"])
    of = lambda kind, count: F.max(F.when(F.col("kind") == kind, F.col(count)))
    lines = ids.groupBy("month").agg(
        of("seller", "every").alias("sellers"),
        of("seller", "flagged").alias("failing_sellers"),
        of("product", "every").alias("promo_products"),
    )
    customers = per_id_flags(orders, ["month"], "o_custkey", {"valid": is_valid()})
    counted = customers.groupBy("month").agg(
        F.count("o_custkey").alias("customers"),
        count_where(F.col("valid") & F.col("o_custkey").isNotNull()).alias("valid_customers"),
    )
    none = F.lit(0).cast("long")
    return spread_join(counted, lines, "month", null_keys=True).select(
        "month", "customers", F.coalesce("sellers", none).alias("sellers"), "valid_customers",
        F.coalesce("failing_sellers", none).alias("failing_sellers"), F.coalesce("promo_products", none).alias("promo_products"),
    )


def customer_counts_rolled_up(t: Tables) -> DataFrame:
    """Customers, completing and failing ones, per city by day, week and month, and of all cities by month.

    One pass over the orders makes sets of customers per day and city, which are
    written once.  All counts come from these sets: a week's set is made of its
    days', that of all cities of theirs.
    """
    homes = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("city"))
    placed = t.orders.select("o_custkey", "o_orderstatus", day("o_orderdate").alias("day")).join(
        homes, F.col("o_custkey") == F.col("c_custkey")
    )
    conditions = {"customers": F.lit(True), "valid_customers": is_valid(), "failing_customers": is_failed()}
    names = list(conditions)
    days = checkpointed(id_sets(placed, ["day", "city"], "o_custkey", conditions))
    weeks = united(days, [sunday_week(F.col("day")).alias("day"), "city"], names)
    months = united(days, [month_start("day").alias("day"), "city"], names)
    shape = lambda grain, counted, city: counted.select(F.lit(grain).alias("grain"), F.col("day").alias("start_day"), city.alias("city"), *names)
    city = F.col("city")
    return reduce(
        DataFrame.unionByName,
        [
            shape("day", sizes(days, ["day", "city"], names), city),
            shape("week", sizes(weeks, ["day", "city"], names), city),
            shape("month", sizes(months, ["day", "city"], names), city),
            shape("month, all cities", sizes(united(months, ["day"], names), ["day"], names), F.lit(None).cast("string")),
        ],
    )


def conditional_amounts(t: Tables) -> DataFrame:
    """Conditional sums and means; ELSE 0 and ELSE NULL give different means."""
    value = money("o_totalprice")
    return t.orders.groupBy("o_orderpriority").agg(
        total(F.when(is_valid(), value).otherwise(0)).alias("valid_value"),
        total(F.when(is_failed(), value)).alias("failed_value"),
        mean(F.when(is_valid(), value)).alias("mean_of_valid"),
        mean(F.when(is_valid(), value).otherwise(0)).alias("mean_with_zeros"),
    )


def conditional_counts(t: Tables) -> DataFrame:
    """Conditional counts of the hits of each day."""
    return t.events.groupBy(day("ts").alias("day")).agg(
        count_where(F.col("event_type") == "view").alias("views"),
        count_where(F.col("event_type") == "purchase").alias("purchases"),
        F.count(F.when(F.col("value") > 100, F.lit(1))).alias("large"),
    )


def distinct_amounts(t: Tables) -> DataFrame:
    """Sum of the distinct amounts beside the full sum: equal amounts count once."""
    return t.lineitem.groupBy("l_returnflag").agg(
        amount(F.sum_distinct(money("l_quantity"))).alias("distinct_quantity"),
        total(money("l_quantity")).alias("quantity"),
    )


def sessions_by_key(t: Tables) -> DataFrame:
    """Distinct sessions per event type, a session being user and day glued together."""
    key = F.concat(F.col("user_id").cast("string"), F.lit("-"), day("ts").cast("string"))
    return t.events.groupBy("event_type").agg(
        F.count_distinct(key).alias("sessions"), F.count_distinct("user_id").alias("users")
    )


def priorities_of_customers(t: Tables) -> DataFrame:
    """The priorities each customer has used, longest name first, as one string."""
    priority = F.col("o_orderpriority")
    return t.orders.groupBy("o_custkey").agg(
        ordered_text(priority, [-F.length(priority), priority], distinct=True).alias("priorities")
    )


def urgent_order_states(t: Tables) -> DataFrame:
    """The states of each customer's urgent orders in order of day, repeats and all; NULL without any."""
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT").select("o_custkey", "o_orderdate", "o_orderstatus")
    joined = t.customer.select("c_custkey").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined_text(joined, ["c_custkey"], F.col("o_orderstatus"), [F.col("o_orderdate")], "states", "")


def counted_priorities_of_customers(t: Tables) -> DataFrame:
    """The priorities each customer has used with the number of orders, as ``name (n)``."""
    counted = t.orders.groupBy("o_custkey", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"), count_where(is_failed()).alias("failed")
    )
    state = F.when(F.col("failed") > 0, "some failed").otherwise("all fine")
    entry = F.concat("o_orderpriority", F.lit(" ("), F.col("orders").cast("string"), F.lit(", "), state, F.lit(")"))
    return counted.groupBy("o_custkey").agg(
        ordered_text(entry, [F.col("o_orderpriority")], "; ", distinct=True).alias("priorities")
    )


def repeated_lines(t: Tables) -> DataFrame:
    """Line keys that are not unique."""
    return repeated_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


def ratios_by_product(t: Tables) -> DataFrame:
    """Guarded ratios: the denominator is zero for some products."""
    lines = t.lineitem.groupBy("l_partkey").agg(
        total(F.when(is_promo_line(), gross())).alias("promo_value"),
        total(gross()).alias("value"),
        count_where(F.col("l_discount") == 0).alias("undiscounted"),
    )
    return lines.select(
        "l_partkey",
        safe_ratio(F.coalesce("promo_value", F.lit(0)), F.col("value")).alias("promo_share"),
        safe_ratio(F.col("value"), F.col("undiscounted")).alias("value_per_undiscounted_line"),
    )


def value_by_flag_columns(t: Tables) -> DataFrame:
    """One column of value per return flag, by seller."""
    columns = [total(F.when(F.col("l_returnflag") == f, gross())).alias(f"value_{f.lower()}") for f in "ANR"]
    return t.lineitem.groupBy("l_suppkey").agg(*columns, total(gross()).alias("value"))


def counted_tests(t: Tables) -> DataFrame:
    """Counting a test counts its non-NULL results, false ones included."""
    labelled = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    return labelled.groupBy("source").agg(
        F.count(F.col("toxic") == 1).alias("tested"),
        count_where(F.col("toxic") == 1).alias("toxic"),
        F.count(F.lit(1)).alias("documents"),
    )
