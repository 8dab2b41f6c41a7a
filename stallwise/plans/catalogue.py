"""Catalogue and account reports: translations, completeness, ratings, source checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.functions.dates import day, within_days
from stallwise.functions.numeric import money, safe_ratio, total
from stallwise.operators.aggregates import count_where
from stallwise.operators.ranking import first_per_key
from stallwise.sources.tables import Tables, gross, is_valid

# The roles a conversation can have a text in.
ROLES = ["system", "user", "assistant"]


def latest_texts(t: Tables) -> DataFrame:
    """The latest text of each role of a conversation, one column per role.

    The latest text is an aggregate (the text of the greatest turn), so one
    grouping does what a ranking per role and a chain of full joins would do.
    """
    order = F.struct("turn", F.length("text"), "text")
    latest = lambda role: F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, order))
    return t.conversations.groupBy("conv_id").agg(
        *[latest(role).alias(f"{role}_text") for role in ROLES],
        F.count_distinct("role").alias("roles"),
    )


def sellers_of_two_periods(t: Tables, first: tuple[dt.date, dt.date], second: tuple[dt.date, dt.date]) -> DataFrame:
    """Value of each seller and type in two periods, whichever of them it sold in."""

    def sold(period: tuple[dt.date, dt.date], name: str) -> DataFrame:
        lines = t.lineitem.filter(within_days("l_shipdate", *period)).select("l_suppkey", "l_partkey", "l_extendedprice")
        typed = lines.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        return typed.groupBy("l_suppkey", "p_type").agg(total(gross()).alias(name))

    return sold(first, "value_before").join(sold(second, "value_after"), ["l_suppkey", "p_type"], "full_outer")


def completeness(t: Tables, least: int) -> DataFrame:
    """Distinct products per seller, the share with a picture, and a size label.

    A product has a picture if its size is above ten.
    """
    offered = t.lineitem.select("l_suppkey", "l_partkey").distinct()
    products = t.part.select("p_partkey", (F.col("p_size") > 10).alias("has_picture"), "p_type")
    listed = offered.join(products, F.col("l_partkey") == F.col("p_partkey"))
    counted = listed.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("products"),
        count_where(F.col("has_picture")).alias("with_picture"),
        F.count_distinct("p_type").alias("types"),
    )
    share = safe_ratio(F.col("with_picture"), F.col("products"))
    label = F.when(F.col("products") < least, "too few").when(share < 0.8, "pictures missing").otherwise("complete")
    return counted.select("*", share.alias("picture_share"), label.alias("label"))


def ratings(t: Tables) -> DataFrame:
    """Mean rating per source over the first review of each order, and how many were reviewed.

    Documents of one source and length stand for the reviews of one order.
    """
    documents = t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id", "left")
    first = first_per_key(documents, ["source", "n_chars"], [F.col("doc_id")])
    return first.groupBy("source").agg(
        F.count(F.lit(1)).alias("orders"),
        F.count("quality").alias("reviewed"),
        safe_ratio(F.sum("quality"), F.count("quality")).alias("mean_quality"),
        safe_ratio(F.sum("toxic"), F.count("toxic")).alias("mean_toxic"),
    )


def active_without_orders(t: Tables, as_of: dt.date, days: int) -> DataFrame:
    """Accounts the customer register holds active and the order book does not."""
    registered = t.customer.filter(money("c_acctbal") > 0).select("c_custkey", "c_name", "c_mktsegment")
    book = t.orders.filter(is_valid()).groupBy("o_custkey").agg(
        F.max(day("o_orderdate")).alias("last_day"), F.count(F.lit(1)).alias("orders")
    )
    idle = book.filter(F.col("last_day") < as_of - dt.timedelta(days=days))
    return registered.join(idle, F.col("c_custkey") == F.col("o_custkey")).drop("o_custkey")
