"""Countries, their cities, and the zones of these, as one nested table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.operators.joins import without
from stallwise.operators.spatial import points_in_zones
from stallwise.operators.unnest import unnest_path
from stallwise.session import shared_folder
from stallwise.sources.leaves import read_leaves
from stallwise.sources.tables import Tables

ZONE = "zone_id:int, name:string, is_active:boolean, shape:struct<ring:array<struct<lon:double,lat:double>>, area:double>"
CITY = f"city_id:int, name:string, zones:array<struct<{ZONE}>>"
SCHEMA = f"country string, entity string, cities array<struct<{CITY}>>"

ZONES_PER_CITY = 3


def _square(x: Column, y: Column, half: Column) -> Column:
    corner = lambda i, j: F.struct((x + i * half).alias("lon"), (y + j * half).alias("lat"))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def _zone(number: int) -> Column:
    """A zone of the city of a row, by a rule: squares of growing size side by side."""
    n, k = F.col("n_nationkey"), F.lit(number)
    x = (n * 13 % 100) / 10.0 + k * 0.7 + 0.05
    y = (n * 29 % 100) / 10.0 + 0.05
    half = k * 0.2 + 0.4
    shape = F.struct(_square(x, y, half).alias("ring"), (4 * half * half).alias("area"))
    return F.struct(
        (n * ZONES_PER_CITY + number).cast("int").alias("zone_id"),
        F.concat("n_name", F.lit(f" zone {number}")).alias("name"),
        ((n + number) % 4 != 0).alias("is_active"),
        shape.alias("shape"),
    )


def countries(t: Tables) -> DataFrame:
    """The nested table, with its declared schema.  A country has few cities, a city few zones."""
    zones = F.array(*[_zone(k) for k in range(ZONES_PER_CITY)])
    cities = t.nation.select(
        "n_regionkey", F.struct(F.col("n_nationkey").alias("city_id"), F.col("n_name").alias("name"), zones.alias("zones")).alias("city")
    )
    listed = cities.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("city")).alias("cities"))
    joined = t.region.join(listed, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    kind = dict(part.split(" ", 1) for part in SCHEMA.split(", ", 2))["cities"]
    empty = F.array().cast(kind)
    return joined.select(
        F.col("r_name").alias("country"), F.concat(F.lit("S_"), F.left("r_name", F.lit(2))).alias("entity"),
        F.coalesce(F.col("cities").cast(kind), empty).alias("cities"),
    )


def written(t: Tables) -> str:
    """The nested table, written once; its folder."""
    folder = f"{shared_folder(t.spark)}/countries-{uuid.uuid4().hex}"
    countries(t).write.parquet(folder)
    return folder


def zones_of_cities(spark: SparkSession, folder: str) -> DataFrame:
    """One row per country, city and zone; cities without zones have none."""
    leaves = ["country", "cities.city_id", "cities.name", "cities.zones.zone_id", "cities.zones.name", "cities.zones.is_active"]
    return unnest_path(read_leaves(spark, folder, SCHEMA, leaves), "cities", "zones").select(
        "country", F.col("cities.city_id").alias("city_id"), F.col("cities.name").alias("city"),
        F.col("zones.zone_id").alias("zone_id"), F.col("zones.name").alias("zone"), F.col("zones.is_active").alias("is_active"),
    )


def zone_list(t: Tables) -> DataFrame:
    return zones_of_cities(t.spark, written(t))


def sellers_at(t: Tables) -> DataFrame:
    """Active sellers with their location: a rule on the number stands in for the map."""
    place = F.struct((F.col("s_suppkey") * 37 % 130 / 10.0).alias("longitude"), (F.col("s_suppkey") * 53 % 110 / 10.0).alias("latitude"))
    sellers = t.supplier.filter(F.col("s_acctbal") > 0).withColumn("location", place)
    return sellers.select("s_suppkey", "s_name", F.col("location.longitude").alias("lon"), F.col("location.latitude").alias("lat"))


def active_zones(spark: SparkSession, folder: str) -> DataFrame:
    zone = [f"cities.zones.{leaf}" for leaf in ("zone_id", "name", "is_active", "shape.ring")]
    rows = read_leaves(spark, folder, SCHEMA, ["cities.name", *zone])
    return unnest_path(rows, "cities", "zones").filter("zones.is_active").select(
        F.col("zones.zone_id").alias("zone_id"), F.col("cities.name").alias("city"), F.col("zones.name").alias("zone"),
        F.col("zones.shape.ring").alias("ring"),
    )


def sellers_by_zone(t: Tables) -> DataFrame:
    """Active sellers with each active zone that holds them, and once without any if none does."""
    sellers = sellers_at(t)
    inside = points_in_zones(sellers, active_zones(t.spark, written(t)), "zone_id", "lon", "lat", "ring")
    outside = without(sellers, inside.select("s_suppkey"), "s_suppkey")
    return inside.unionByName(outside, allowMissingColumns=True).select("s_suppkey", "s_name", "lon", "lat", "zone_id", "city", "zone")
