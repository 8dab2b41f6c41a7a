"""What the physical plans look like, and properties of whole reports."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from stallwise import registry
from stallwise.operators.aggregates import with_group_totals
from stallwise.operators.joins import having
from stallwise.plans import customers, orders, promotions, scanning
from stallwise.sources.mappings import mapping_sheet
from stallwise.sources.scans import local_window
from stallwise.sources.tables import is_valid

WRITING = {"rolling_session_refresh", "ctas_daily_overview", "cost_table_vouchers", "cost_table_discounts"}
LAZY = sorted(set(registry.PLANS) - WRITING)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairing_of_everything_and_no_python(spark, name):
    plan = plan_of(registry.queries()[name](spark, SMALL))
    for node in ["CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "Scan ExistingRDD"]:
        assert node not in plan


# Scans of the lines, and how often they are shuffled by their order, for jobs that sum lines per order.
ONE_MEETING = [
    "run_rate_projection", "run_rate_redemptions", "cap_allocation", "campaign_single_pass", "promo_performance", "basket_size",
    "delivery_fee_by_weekday",
]


@pytest.mark.parametrize("name", ONE_MEETING)
def test_lines_are_moved_once_to_their_order(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(registry.queries()[name](spark, SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*orderkey[^)]*), \d+\)", plan)
    assert plan.count("lineitem.parquet") == 1
    assert len(keys) == 2 and not any("," in key for key in keys)  # lines once, orders once, each by the order alone


def test_words_are_moved_once(spark):
    plan = plan_of(registry.queries()["explode_nested"](spark, SMALL))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Generate explode") == 1


def test_bounds_and_columns_reach_the_scan(tables):
    plan = plan_of(registry.SCANNING["scan_partition_window"](tables))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in plan


def test_a_date_bound_prunes_partitions(spark, tables, tmp_path):
    path = str(tmp_path / "orders")
    tables.orders.filter("o_orderdate < '1995-03-01'").withColumn("day", F.to_date("o_orderdate")).write.partitionBy("day").parquet(path)
    facts = spark.read.parquet(path)
    start, end = dt.date(1995, 1, 10), dt.date(1995, 2, 12)
    bounded = local_window(facts, "day", F.to_date("o_orderdate"), start, end, kind="date")
    scan = [line for line in plan_of(bounded).splitlines() if "FileScan" in line][0]
    assert "(day#" in scan.split("PartitionFilters: [")[1].split("]")[0] and "cast(day" not in scan
    expected = tables.orders.filter("o_orderdate >= '1995-01-10' and o_orderdate < '1995-02-13'").count()
    assert bounded.count() == expected > 0


def test_a_frequent_key_is_split(spark):
    names = {
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        rows = spark.range(0, 200_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.xxhash64("id").alias("v")
        )
        out = with_group_totals(rows, ["k"], n=F.count(F.lit(1)))
        checks = out.groupBy("k").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"))
        collected = checks.filter("n <> rows or k = 0").collect()
        assert [(r["k"], r["n"], r["rows"]) for r in collected] == [(0, 66_667, 66_667)]
        assert "skew=true" in executed(out)
        few = spark.range(7).select(F.col("id").alias("k"))
        assert "skew=true" in executed(having(rows, few.union(few), "k"))
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def executed(df) -> str:
    """The final plan of a run of the same frame."""
    query = df._jdf.queryExecution()
    query.executedPlan().execute().count()
    return query.executedPlan().toString()


def test_mapping_sheet(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text("channel,share\n Retail , 60\nភ្នំពេញ,5\n", encoding="utf-8")
    rows = mapping_sheet(spark, str(path), "channel string, share int").collect()
    assert [tuple(r) for r in rows] == [("Retail", 60), ("ភ្នំពេញ", 5)]


def test_first_per_key_limits_before_the_shuffle(tables):
    plan = plan_of(registry.RANKING["win_first_per_key"](tables))
    assert plan.count("WindowGroupLimit") == 2  # partial, then final


def test_topk_needs_no_full_sort(tables):
    assert "TakeOrderedAndProject" in plan_of(registry.RANKING["topk_limit"](tables))


def test_exact_sums_stay_in_hash_aggregates(tables):
    plan = plan_of(registry.AGGREGATION["agg_basic"](tables))
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_weekly_report_adds_up(tables):
    report = orders.weekly_kpis(tables).agg(F.sum("order_count"), F.sum("gross_orders"), F.sum("failed_orders"), F.sum("new_customer_count")).first()
    everything = tables.orders.count()
    valid = tables.orders.filter(is_valid()).count()
    assert tuple(report)[:3] == (valid, everything, everything - valid)
    assert report[3] == tables.orders.filter(is_valid()).select("o_custkey").distinct().count()


def test_base_growth_ends_with_every_customer(tables):
    growth = customers.base_growth(tables)
    last = growth.groupBy("city").agg(F.max("customers_so_far").alias("n"), F.sum("new_customers").alias("new"))
    assert last.filter("n <> new").count() == 0


def test_daily_spine_and_monthly_shares_count_the_same_days(tables):
    by_day = promotions.campaigns_per_day(tables).agg(F.sum("campaigns")).first()[0]
    by_month = promotions.cost_by_month(tables).agg(F.sum("days")).first()[0]
    assert by_day == by_month


def test_flag_counts_cover_every_document(tables):
    for row in scanning.flag_counts(tables).collect():
        assert row["is_true"] + row["is_false"] + row["missing"] == row["documents"]
        assert row["negated"] == row["is_false"] and row["not_false"] == row["is_true"] + row["missing"]


def test_report_keys_are_unique(tables):
    for frame, keys in [
        (orders.weekly_kpis(tables), ["week", "country", "city"]),
        (orders.failure_rates(tables, registry.AS_OF, 90), ["p_partkey"]),
        (promotions.performance(tables), ["p_brand", "l_suppkey"]),
        (customers.churn_features(tables, registry.AS_OF, 6), ["o_custkey"]),
    ]:
        assert frame.groupBy(*keys).count().filter("count > 1").count() == 0


def test_every_customer_has_a_place(tables):
    from stallwise.plans import geography

    placed = geography.placed_customers(tables, registry.AS_OF)
    assert placed.count() == placed.select("c_custkey").distinct().count() == tables.customer.count()
