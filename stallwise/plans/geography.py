"""Zones, points and distances.

Points are the first two coordinates of each embedding, read as degrees of
longitude and latitude.  Every label has a zone, a diamond around the middle of
its points; one more zone, the catch-all, is the rectangle around the middle
half of all points.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.functions.dates import minus_months, within_days
from stallwise.operators.joins import having, spread_join, without
from stallwise.operators.spatial import points_in_zones, points_outside_zones, within_distance
from stallwise.sources.tables import Tables

CATCH_ALL = "everywhere"


def points(t: Tables) -> DataFrame:
    coordinate = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return t.embeddings.select("vec_id", "label", coordinate(0).alias("lon"), coordinate(1).alias("lat"))


def corner(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def zones(t: Tables) -> DataFrame:
    """Zone name and ring."""
    span = lambda df: df.agg(
        F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north")
    )
    x, y = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
    a, b = (F.col("east") - F.col("west")) / 4, (F.col("north") - F.col("south")) / 4
    diamond = F.array(corner(x + a, y), corner(x, y + b), corner(x - a, y), corner(x, y - b))
    rectangle = F.array(corner(x - a, y - b), corner(x + a, y - b), corner(x + a, y + b), corner(x - a, y + b))
    labelled = span(points(t).groupBy("label")).select(F.concat(F.lit("zone "), F.col("label")).alias("zone"), diamond.alias("ring"))
    everywhere = span(points(t).groupBy()).select(F.lit(CATCH_ALL).alias("zone"), rectangle.alias("ring"))
    return labelled.unionByName(everywhere)


def assigned(t: Tables) -> DataFrame:
    """Every point with every zone that holds it."""
    inside = points_in_zones(points(t), zones(t), "zone", "lon", "lat", "ring")
    return inside.select("vec_id", "zone", "lon", "lat")


def unassigned(t: Tables) -> DataFrame:
    """Points in no zone."""
    outside = points_outside_zones(points(t), zones(t), "vec_id", "zone", "lon", "lat", "ring")
    return outside.select("vec_id", "label")


def resolved(t: Tables) -> DataFrame:
    """Zones of each point where the catch-all gives way to any other; without a zone, its own label."""
    inside = points_in_zones(points(t).drop("label"), zones(t), "zone", "lon", "lat", "ring")
    # A group holds the zones over one point, so a window is small.
    counted = inside.select("vec_id", "zone", F.count(F.lit(1)).over(Window.partitionBy("vec_id")).alias("zones"))
    kept = counted.filter((F.col("zones") == 1) | (F.col("zone") != CATCH_ALL))
    own = F.concat(F.lit("label "), F.col("label"))
    return points(t).select("vec_id", "label").join(kept, "vec_id", "left").select(
        "vec_id", F.coalesce("zone", own).alias("zone"), F.coalesce("zones", F.lit(0)).alias("zones")
    )


def placed_customers(t: Tables, as_of: dt.date) -> DataFrame:
    """Every customer with the place of the first order of the last three months, or else the own one."""
    at = points(t).select(F.col("vec_id").alias("_point"), "lon", "lat")
    recent = t.orders.filter(within_days("o_orderdate", minus_months(as_of, 3), as_of))
    first = recent.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("first"))
    number = F.coalesce(F.col("first.o_orderkey"), F.col("c_custkey"))
    people = spread_join(t.customer.select("c_custkey"), first, "c_custkey").withColumn("_place", _point_of(t, number))
    placed = people.join(at, F.col("_place") == F.col("_point"), "left")
    missing = F.raise_error(F.concat(F.lit("no point has the number "), F.col("_place").cast("string"))).cast("double")
    return placed.select("c_custkey", F.when(F.col("_point").isNull(), missing).otherwise(F.col("lon")).alias("lon"), "lat")


def _point_of(t: Tables, number: Column) -> Column:
    return F.pmod(number, t.embeddings.agg(F.count(F.lit(1))).scalar())


def audience(t: Tables, keyword: str, metres: float, as_of: dt.date) -> DataFrame:
    """Customers near a seller that matches a keyword, without its present customers.

    Points are numbered from 0.  A customer is where the first order of the last
    three months was placed, at the point with its number, or else at home, at
    the point with the customer's own number; a seller likewise.  Numbers beyond
    the last point begin anew, so everyone has a place.  The present customers
    are those with any order at a matching seller.
    """
    at = points(t).select("vec_id", "lon", "lat")
    matching = t.supplier.filter(F.lower("s_name").contains(keyword.lower()))
    spots = at.select(F.col("vec_id").alias("_point"), F.col("lon").alias("seller_lon"), F.col("lat").alias("seller_lat"))
    centres = matching.select("s_suppkey", "s_name", _point_of(t, F.col("s_suppkey")).alias("_place"))
    centres = centres.join(spots, F.col("_place") == F.col("_point")).drop("_place", "_point")
    people = placed_customers(t, as_of)
    ordered = having(
        t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("s_suppkey")), matching.select("s_suppkey"), "s_suppkey"
    )
    present = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(
        ordered, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi"
    )
    free = without(people, present.select("c_custkey"), "c_custkey")
    near = within_distance(free, centres, ("lon", "lat"), ("seller_lon", "seller_lat"), metres, "distance")
    return near.select("s_suppkey", "s_name", "c_custkey", F.round("distance").cast("long").alias("distance"))
