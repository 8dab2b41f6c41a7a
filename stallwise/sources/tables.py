"""Access to the parquet tables and the views the jobs share.

Roles: orders are customer orders, lineitem their lines (with the amounts),
supplier the seller, part the product, nation the city and region the country
of a seller, events the hits of web sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.functions.dates import day
from stallwise.functions.numeric import cents, money, percent

# Declared, so that reading a table starts no job to look into file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

PROMO_DISCOUNT = 0.05


class Tables:
    """The parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")


def is_valid() -> Column:
    """A completed order."""
    return F.col("o_orderstatus") != "P"


def is_failed() -> Column:
    return F.col("o_orderstatus") == "P"


def is_promo_line() -> Column:
    return F.col("l_discount") > PROMO_DISCOUNT


# Amounts of a line, in ticks.


def gross() -> Column:
    """Before discount."""
    return money("l_extendedprice")


def discount_amount() -> Column:
    return cents("l_extendedprice") * percent("l_discount")


def net() -> Column:
    """After discount."""
    return cents("l_extendedprice") * (100 - percent("l_discount"))


def tax_amount() -> Column:
    return cents("l_extendedprice") * percent("l_tax")


def order_days(orders: DataFrame) -> DataFrame:
    """Orders with their calendar day."""
    return orders.withColumn("order_day", day("o_orderdate"))


def order_values(lineitem: DataFrame) -> DataFrame:
    """One row per order: amounts (in ticks) and promotion flags of its lines."""
    return lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(gross()).alias("gmv"),
        F.sum(net()).alias("gfv"),
        F.sum(F.when(is_promo_line(), discount_amount())).alias("promo_cost"),
        F.bool_or(is_promo_line()).alias("has_promo"),
        F.bool_or(F.col("l_tax") == 0).alias("has_voucher"),
    )
