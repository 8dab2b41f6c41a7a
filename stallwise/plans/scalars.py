"""Every scalar function over whole columns, one output column each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.functions.dates import (
    day,
    day_series,
    iso_week_label,
    local_day,
    month_start,
    sunday_week,
    weekday_label,
    year_start,
)
from stallwise.functions.numeric import (
    round_to_scale,
    safe_ratio,
    strict_greatest,
    strict_least,
)
from stallwise.sources.tables import Tables


def string_functions(t: Tables) -> DataFrame:
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    unset = F.when(F.col("c_acctbal") > 0, segment)
    return t.customer.select(
        "c_custkey",
        F.lower(segment).alias("lowered"),
        F.upper(F.concat(name, F.lit("é"))).alias("uppered"),
        F.concat(name, F.lit(" ("), segment, F.lit(")")).alias("joined"),
        F.concat(name, F.lit("/"), unset).alias("joined_or_null"),
        F.substring(name, 1, 7).alias("first_seven"),
        F.left(name, F.lit(3)).alias("first_three"),
        F.length(segment).alias("length"),
        F.replace(name, F.lit("#"), F.lit("")).alias("replaced"),
        F.col("c_custkey").cast("string").alias("key_text"),
        F.substring(name, 10, 9).cast("bigint").alias("number"),
        F.replace(F.substring(name, 10, 9), F.lit("00"), F.lit("0")).cast("double").alias("float_number"),
    )


def date_functions(t: Tables) -> DataFrame:
    date = day("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        date.alias("date"),
        F.date_sub(date, 10).alias("minus_10_days"),
        F.date_add(date, 3 * 7).alias("plus_3_weeks"),
        F.add_months(date, -3).alias("minus_3_months"),
        F.add_months(date, 1).alias("plus_1_month"),
        F.add_months(date, -12 * 2).alias("minus_2_years"),
        F.date_add(date, F.length("o_orderpriority")).alias("plus_column_days"),
        F.datediff(F.lit("2001-08-02").cast("date"), date).alias("age_days"),
        month_start(date).alias("month_start"),
        year_start(date).alias("year_start"),
        sunday_week(date).alias("week_start"),
        iso_week_label(date).alias("iso_week"),
        weekday_label(date).alias("weekday"),
        F.year(date).alias("year"),
        F.month(date).alias("month"),
        F.dayofweek(date).alias("day_of_week"),
        F.last_day(date).alias("month_end"),
        date.cast("string").alias("text"),
        F.size(day_series(date, F.add_months(date, 1))).alias("days_in_series"),
        F.size(day_series(date, F.date_sub(date, 1))).alias("days_in_reversed"),
    )


def time_functions(t: Tables) -> DataFrame:
    zone = (
        F.when(F.col("event_type") == "view", "Asia/Phnom_Penh")
        .when(F.col("event_type") == "click", "America/New_York")
        .otherwise("Europe/Berlin")
    )
    return t.events.select(
        "event_id",
        F.hour("ts").alias("hour"),
        day("ts").alias("utc_day"),
        day(F.col("ts") + F.expr("INTERVAL 7 HOURS")).alias("day_plus_7h"),
        local_day(F.col("ts"), zone).alias("local_day"),
    )


def number_functions(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    discount, tax = (F.col(c).cast("decimal(4,2)") for c in ["l_discount", "l_tax"])
    shown = F.when(F.col("l_returnflag") != "R", discount)
    net = price * (1 - discount)
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        safe_ratio(price, discount).alias("guarded_ratio"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("ratio"),
        F.round(net, 2).cast("double").alias("rounded"),
        F.round(-net, 1).cast("double").alias("rounded_negative"),
        round_to_scale(net, F.col("l_linenumber") % 4).alias("rounded_to_column"),
        F.ceil(net).cast("long").alias("ceiling"),
        strict_greatest(shown, tax).cast("double").alias("greater"),
        strict_least(shown, tax).cast("double").alias("lesser"),
        F.ifnull(shown, F.lit(0)).cast("double").alias("or_zero"),
        F.coalesce(shown, F.when(tax > 0, tax), F.lit(-1)).cast("double").alias("first_known"),
        (-1 * price * discount / 100).cast("double").alias("scaled"),
    )


def array_functions(t: Tables) -> DataFrame:
    words = F.split("text", " ")
    listed = F.array(F.lit("en"), F.lit("fr"))
    tags = F.array("lang", F.lit(None).cast("string"), "source")
    return t.documents.filter(F.size(words) > 0).select(
        "doc_id",
        F.array_join(tags, ",").alias("tags"),
        F.array_contains(listed, F.col("lang")).alias("listed"),
        (~F.array_contains(listed, F.col("lang"))).alias("not_listed"),
        F.array_contains(words, "the").alias("has_the"),
        F.size(words).alias("words"),
        F.array_join(F.slice(words, 1, 5), " ").alias("first_five"),
        F.size(listed).alias("list_length"),
    )
