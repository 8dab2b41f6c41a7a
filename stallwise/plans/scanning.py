"""Scans, predicates and classification."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions.dates import day, month_start
from stallwise.functions.flags import is_false, is_true, not_false
from stallwise.functions.numeric import money, total
from stallwise.operators.aggregates import count_where
from stallwise.sources.scans import between_scalars, local_window, since_month_start
from stallwise.sources.tables import Tables, gross, is_valid


def orders_by_local_day(t: Tables, start: dt.date, end: dt.date, offset_hours: int) -> DataFrame:
    """Orders and value per local day, read through the UTC window around it."""
    local = day(F.col("o_orderdate") + F.make_dt_interval(hours=F.lit(offset_hours)))
    orders = local_window(t.orders, "o_orderdate", local, start, end)
    return orders.groupBy(local.alias("local_day")).agg(
        F.count(F.lit(1)).alias("orders"), total(money("o_totalprice")).alias("value")
    )


def orders_by_recent_month(t: Tables, as_of: dt.date, months: int) -> DataFrame:
    """Orders per month since the month start some months before the run date."""
    recent = since_month_start(t.orders, "o_orderdate", as_of, months)
    return recent.groupBy(month_start("o_orderdate").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), count_where(is_valid()).alias("valid_orders")
    )


def lines_with_products(t: Tables) -> DataFrame:
    """All columns of lines and products but a few."""
    lines, parts = t.lineitem.alias("l"), t.part.alias("p")
    joined = lines.join(parts, F.col("l.l_partkey") == F.col("p.p_partkey"))
    return joined.select("l.*", "p.*").drop("p_partkey", "l_tax", "p_retailprice")


def flag_counts(t: Tables) -> DataFrame:
    """How many documents pass each form of test on a flag that may be missing."""
    good = F.col("quality") == 1
    documents = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return documents.groupBy("lang").agg(
        count_where(is_true(good)).alias("is_true"),
        count_where(is_false(good)).alias("is_false"),
        count_where(~good).alias("negated"),
        count_where(not_false(good)).alias("not_false"),
        count_where(good.isNull()).alias("missing"),
        F.count(F.lit(1)).alias("documents"),
    )


def membership(t: Tables, brands: list[str], excluded_types: list[str], min_balance: int) -> DataFrame:
    """Lines of listed brands, outside listed types, from sellers in a list table."""
    parts = t.part.filter(F.col("p_brand").isin(brands) & ~F.col("p_type").isin(excluded_types))
    listed = t.supplier.filter(F.col("s_acctbal") >= min_balance).select(F.col("s_suppkey").alias("l_suppkey"))
    lines = t.lineitem.join(listed, "l_suppkey", "left_semi")
    joined = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    return joined.groupBy("p_brand", "p_type").agg(
        F.count(F.lit(1)).alias("lines"), total(gross()).alias("value")
    )


def pattern_counts(t: Tables, keyword: str) -> DataFrame:
    """Products and documents by substring, prefix, wildcard, run-time and non-Latin patterns."""
    name = F.lower("p_name")
    parts = t.part.agg(
        count_where(name.like("%bolt%")).alias("substring"),
        count_where(name.like("red%")).alias("prefix"),
        count_where(name.like("s%l%gear")).alias("wildcards"),
        count_where(~name.like("%widget%")).alias("negated"),
        count_where(name.contains(keyword.lower())).alias("keyword"),
        F.count(F.lit(1)).alias("total"),
    )
    text = F.lower("text")
    documents = t.documents.agg(
        count_where(text.like("%tion%")).alias("substring"),
        count_where(text.like("the%")).alias("prefix"),
        count_where(text.like("%the%and%")).alias("wildcards"),
        count_where(~text.like("%ü%")).alias("negated"),
        count_where(text.contains(keyword.lower())).alias("keyword"),
        F.count(F.lit(1)).alias("total"),
    )
    named = lambda df, label: df.select(F.lit(label).alias("source"), "*")
    return named(parts, "products").unionByName(named(documents, "documents"))


def vertical(priority: Column, kind: Column, brand: Column) -> Column:
    """Ordered cascade with a nested branch: the first rule that holds decides."""
    return (
        F.when(priority == "5-LOW", "Pickup")
        .when(brand.isin("Brand#1", "Brand#2"), "Concepts")
        .when(kind == "PROMO", F.when(priority == "1-URGENT", "Express promo").otherwise("Promo"))
        .when(kind.isin("SMALL", "MEDIUM"), "Shops")
        .when(brand.like("Brand#2_"), "Kitchens")
        .otherwise("Food")
    )


def city_label(city: Column) -> Column:
    """Suburbs are reported under the city they belong to."""
    return F.when(city.isin("NATION_5", "NATION_10"), "NATION_0").otherwise(city)


def classified_lines(t: Tables) -> DataFrame:
    """Lines per vertical and reported city of the seller."""
    orders = t.orders.select("o_orderkey", "o_orderpriority")
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    cities = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    joined = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .join(cities, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    label = vertical(F.col("o_orderpriority"), F.col("p_type"), F.col("p_brand"))
    return joined.groupBy(label.alias("vertical"), city_label(F.col("n_name")).alias("city")).agg(
        F.count(F.lit(1)).alias("lines"), total(gross()).alias("value")
    )


def orders_between_scalars(t: Tables) -> DataFrame:
    """Orders between the first and the last shipment, per status."""
    ships = t.lineitem
    bounded = between_scalars(
        t.orders, "o_orderdate", ships.agg(F.min("l_shipdate")), ships.agg(F.max("l_shipdate") - F.expr("INTERVAL 180 DAYS"))
    )
    return bounded.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), F.max(day("o_orderdate")).alias("last_day")
    )


def distinct_offers(t: Tables) -> DataFrame:
    """Which seller offers which brand and type."""
    lines = t.lineitem.select("l_suppkey", "l_partkey").distinct()
    parts = t.part.select("p_partkey", "p_brand", "p_type")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand", "p_type").distinct()
