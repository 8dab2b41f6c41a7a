"""Nested tables read by leaf, and facts laid out by key."""

from __future__ import annotations

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from stallwise.operators.unnest import unnest_path
from stallwise.plans import nested, orders
from stallwise.session import scratch_database
from stallwise.sources.leaves import declared, read_leaves
from stallwise.sources.layout import LaidOut, files_per_bucket, write_bucketed


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def read_schema(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return next(line for line in plan_of(df).splitlines() if "ReadSchema" in line).split("ReadSchema: ")[1]


@pytest.fixture(scope="module")
def folder(tables):
    return nested.written(tables)


def test_declared_schema(spark, folder):
    assert spark.read.parquet(folder).schema.simpleString() == declared(nested.SCHEMA).simpleString()


def test_only_used_leaves_are_read(spark, folder):
    schema = read_schema(nested.zones_of_cities(spark, folder))
    assert "shape" not in schema and "area" not in schema and "entity" not in schema
    assert "is_active" in schema and "zone_id" in schema
    rings = read_schema(nested.active_zones(spark, folder))
    assert "shape:struct<ring:array" in rings and "area" not in rings and "city_id" not in rings
    whole = spark.read.parquet(folder).select(F.col("cities")).collect()
    names = unnest_path(read_leaves(spark, folder, nested.SCHEMA, ["cities.zones.name"]), "cities", "zones").select("zones.name")
    assert sorted(r["name"] for r in names.collect()) == sorted(z["name"] for r in whole for c in r["cities"] for z in c["zones"])


def test_leaves_that_do_not_exist(spark, folder):
    with pytest.raises(ValueError, match="no such fields"):
        read_leaves(spark, folder, nested.SCHEMA, ["cities.streets"])
    with pytest.raises(ValueError, match="no fields in"):
        read_leaves(spark, folder, nested.SCHEMA, ["country.name"])


def test_path_loses_parents_without_elements(spark):
    rows = [(1, [("a", [1, 2]), ("b", []), ("c", None)]), (2, []), (3, None), (4, [("d", [3])])]
    df = spark.createDataFrame(rows, "id int, xs array<struct<name:string, ys:array<int>>>")
    out = unnest_path(df, "xs", "ys").select("id", "xs.name", "ys")
    assert sorted(map(tuple, out.collect())) == [(1, "a", 1), (1, "a", 2), (4, "d", 3)]


@pytest.fixture(scope="module")
def laid_out(spark, tables):
    return LaidOut(tables, scratch_database(spark), 8)


def test_orders_and_lines_meet_in_place(spark, laid_out):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")  # sellers are small, orders and lines are not
    try:
        lines = laid_out.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("n"))
        plan = plan_of(laid_out.orders.join(lines, "o_orderkey", "left"))
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        # In the report, everything below the join of orders and lines stays in place; customers come afterwards.
        report = plan_of(orders.placed_orders(laid_out)).splitlines()
        join = next(i for i, line in enumerate(report) if "o_orderkey" in line and "Join" in line and "LeftOuter" in line)
        depth = report[join].index("SortMergeJoin")
        below = [line for line in report[join + 1 :] if len(line) - len(line.lstrip(" :+-")) > depth]
        assert below and not any("Exchange hashpartitioning" in line for line in below)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_report_is_the_same(tables, laid_out):
    rows = lambda t: sorted(map(str, orders.weekly_kpis(t).collect()))
    assert rows(laid_out) == rows(tables)


def test_one_file_per_bucket(spark):
    table = f"{scratch_database(spark)}.numbers"
    df = write_bucketed(spark.range(1000).repartition(7), table, "id", 5)
    assert df.count() == 1000 and files_per_bucket(df) == 1
    assert write_bucketed(spark.range(10), table, "id", 5).count() == 10
