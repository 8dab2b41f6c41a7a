"""Work per task that stays small on larger tables: sets instead of pairs, places instead of points."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from stallwise.operators.bitmaps import id_sets, sizes
from stallwise.operators.spatial import within_distance
from stallwise.plans.accounts import compliance
from stallwise.plans.aggregation import distinct_counts_by_month
from stallwise.sources.tables import SCHEMAS, Tables


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def tables_of(spark, folder, **rows) -> Tables:
    """The given tables, whose columns are those of the first row (a dict); missing ones are NULL."""
    for name, given in rows.items():
        schema = spark.createDataFrame([], SCHEMAS[name]).schema
        spark.createDataFrame([tuple(row.get(f) for f in schema.names) for row in given], schema).write.parquet(f"{folder}/{name}.parquet")
    return Tables(spark, str(folder))


def test_sets_of_scattered_ids_are_small(spark):
    ids = [-(2**40), -65, -64, -1, 0, 63, 64, 2**40, 2**40, 2**62]
    df = spark.createDataFrame([(i % 2, i) for i in ids], "day bigint, id bigint")
    sets = id_sets(df, ["day"], "id", {"every": F.lit(True), "even": F.col("id") % 2 == 0})
    assert dict(sets.dtypes)["every"] == "bigint"  # 8 bytes a set, where a bitmap of 32,768 ids took 4 kB
    assert "SortAggregate" not in plan_of(sets)
    assert {tuple(r) for r in sizes(sets, ["day"], ["every", "even"]).collect()} == {(0, 6, 6), (1, 3, 0)}


def test_places_are_measured_once(spark):
    points = spark.createDataFrame([(i, float(i % 3), 0.0) for i in range(60)] + [(60, None, 0.0)], "p int, lon double, lat double")
    centres = spark.createDataFrame([(i, float(i % 2), -0.0) for i in range(10)], "c int, x double, y double")
    met = within_distance(points, centres, ("lon", "lat"), ("x", "y"), 9000.0, "m")
    assert met.columns == ["p", "lon", "lat", "c", "x", "y", "m"]
    assert {(r["p"], r["c"]) for r in met.collect()} == {(p, c) for p in range(60) for c in range(10) if p % 3 == c % 2}
    assert met.count() == 200
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_x" in plan and "Aggregate [_lon" in plan  # distances are those of different places


def test_compliance_keeps_no_row_per_pair(spark, tmp_path):
    as_of, old, new = dt.date(2001, 8, 2), dt.datetime(1999, 1, 1), dt.datetime(2001, 8, 1, 9)
    line = lambda order, part, seller: {"l_orderkey": order, "l_partkey": part, "l_suppkey": seller, "l_extendedprice": 10.0, "l_discount": 0.1}
    order = lambda key, state, at: {"o_orderkey": key, "o_orderstatus": state, "o_orderdate": at}
    part = lambda key, name, size: {"p_partkey": key, "p_name": name, "p_size": size}
    t = tables_of(
        spark, tmp_path,
        supplier=[{"s_suppkey": k, "s_name": f"s{k}"} for k in (1, 2, 3)],
        part=[part(1, "a", 20), part(1, "a", 5), part(2, "b", None), part(200, "c", 11), part(3, "A Widget", 20), part(4, None, 20)],
        orders=[order(1, "F", old), order(2, "F", new), order(3, "P", new), order(4, "P", old), order(5, None, new), order(6, "F", None)],
        lineitem=[
            line(1, 1, 1), line(1, 1, 1), line(1, 2, 1), line(2, 200, 1), line(2, 200, 1), line(3, 4, 1), line(5, 1, 1),
            line(4, 3, 2), line(6, 3, 2), line(9, 2, 2), line(None, None, 2),
        ],
    )
    got = compliance(t, as_of, weeks=4)
    found = {r["l_suppkey"]: tuple(r)[2:-2] for r in got.collect()}
    assert found == {
        1: (4, 2, dt.date(1999, 1, 1), 3, 1, 1, 20.0, 18.0),  # a part listed twice counts twice
        2: (1, 0, None, 0, 0, 0, 0.0, 0.0),
        3: (None,) * 8,
    }
    assert not re.search(r"keys=\[l_suppkey#\d+L, l_(part|order)key#", plan_of(got))


def test_months_count_ids_by_sets(spark, tmp_path):
    order = lambda key, customer, state, month: {"o_orderkey": key, "o_custkey": customer, "o_orderstatus": state, "o_orderdate": dt.datetime(2000, month, 5)}
    line = lambda key, seller, part, discount: {"l_orderkey": key, "l_suppkey": seller, "l_partkey": part, "l_discount": discount}
    t = tables_of(
        spark, tmp_path,
        orders=[order(1, 7, "F", 1), order(2, 7, "P", 1), order(3, 8, None, 1), order(4, None, "P", 2), order(5, 9, "F", 3)],
        lineitem=[
            line(1, 1, 500, 0.1), line(1, 2, 501, 0.0), line(2, 1, 500, 0.1), line(2, -3, 502, 0.1), line(3, 10**12, None, 0.1),
            line(3, None, 503, None), line(4, None, 501, 0.0), line(None, 4, 4, 0.1),
        ],
    )
    got = distinct_counts_by_month(t)
    # month, customers, sellers, valid customers, failing sellers, promoted products
    assert {(r[0].month, *tuple(r)[1:]) for r in got.collect()} == {(1, 2, 4, 1, 2, 2), (2, 0, 0, 0, 0, 0), (3, 1, 0, 1, 0, 0)}
    assert not re.search(r"keys=\[month#\d+, kind#\d+, id#\d+L\]", plan_of(got))
