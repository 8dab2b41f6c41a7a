"""Point-in-polygon and distance joins through cells as hash keys.

Only the exact test decides; the cells merely limit which pairs are tested, so
their size affects speed and never the result.  A crowded cell is a frequent join
key: the skew-join rule splits it, unless the other side is small enough to be
broadcast, where no rows of the cell meet in one task at all.

Zones are covered by cells of several sizes: large ones where a cell lies wholly
inside, whose points need no test, and small ones along the edge.  A country and a
street so have about as many cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions.geo import (
    METRES_PER_DEGREE,
    cell,
    distance_m,
    in_polygon,
    ring_bounds,
)
from stallwise.operators.joins import without
from stallwise.session import checkpointed

#: Degrees of a cell of level 0; each level halves them.
WIDEST = 64.0
LEVELS = range(25)
#: How often the cells along an edge are cut, and how many of them a zone may come to.
CUTS = 5
MOST_CELLS = 1024


def _cells(low, high, size: float):
    return F.explode(F.sequence(cell(low, size), cell(high, size)))


def _edges(ring: Column) -> Column:
    """The sides of a ring."""
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, (i + 1) % F.size(ring)).alias("b")))


def _touches(edges: Column, x: Column, y: Column, size: Column) -> Column:
    """Whether any side meets a cell, borders included: boxes overlap, and the corners are not all on one side of the line."""

    def meets(side: Column) -> Column:
        a, b = side["a"], side["b"]
        dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
        corners = [dx * (y + j * size - a["lat"]) - dy * (x + i * size - a["lon"]) for i in (0, 1) for j in (0, 1)]
        near = (F.abs(dx) + F.abs(dy)) * size * 1e-9  # a side this close counts as touching
        apart = (F.least(*corners) > near) | (F.greatest(*corners) < -near)
        overlap = (F.least(a["lon"], b["lon"]) <= x + size) & (F.greatest(a["lon"], b["lon"]) >= x)
        overlap &= (F.least(a["lat"], b["lat"]) <= y + size) & (F.greatest(a["lat"], b["lat"]) >= y)
        return overlap & ~apart

    return F.exists(edges, meets)


def _cut(rows: DataFrame, k: int, most: int, last: bool) -> DataFrame:
    """One step of ``cover``: what of the open cells is listed, and the quarters of the others."""
    size = F.lit(WIDEST) / F.pow(F.lit(2.0), F.col("_level") + k)
    marked = F.transform(
        "_open",
        lambda c: F.struct(
            c["x"].alias("x"),
            c["y"].alias("y"),
            _touches(F.col("_edges"), c["x"] * size, c["y"] * size, size).alias("edge"),
            in_polygon((c["x"] + 0.5) * size, (c["y"] + 0.5) * size, F.col("_ring")).alias("middle"),
        ),
    )
    rows = rows.withColumn("_marked", marked)
    rows = rows.withColumn("_ends", F.lit(True) if last else F.size(F.filter("_marked", lambda c: c["edge"])) * 4 > most)
    listed = F.transform(
        F.filter("_marked", lambda c: F.when(c["edge"], F.col("_ends")).otherwise(c["middle"])),
        lambda c: F.struct((F.col("_level") + k).alias("level"), c["x"].alias("cx"), c["y"].alias("cy"), (~c["edge"]).alias("inside")),
    )
    quarter = lambda c, i, j: F.struct((c["x"] * 2 + i).alias("x"), (c["y"] * 2 + j).alias("y"))
    below = F.flatten(
        F.transform(
            F.filter("_marked", lambda c: c["edge"] & ~F.col("_ends")),
            lambda c: F.array(quarter(c, 0, 0), quarter(c, 0, 1), quarter(c, 1, 0), quarter(c, 1, 1)),
        )
    )
    return rows.withColumns({f"_cells_{k}": listed, "_open": below}).drop("_marked", "_ends")


def cover(zones: DataFrame, zone: str, ring: str, cuts: int = CUTS, most: int = MOST_CELLS) -> DataFrame:
    """The cells of every zone: ``level``, ``cx``, ``cy``, and whether the cell lies wholly ``inside``.

    A zone begins with the few cells, about as large as it is, that its bounding box
    touches.  Cells without a side in them are inside or go; the others are cut in
    four, ``cuts`` times, or until the next cut could make more than ``most``.  All
    of it happens in the zone's own row.
    """
    west, south, east, north = ring_bounds(F.col(ring))
    extent = F.greatest(east - west, north - south)
    level = F.when(extent > 0, F.floor(F.log2(F.lit(WIDEST) / extent))).otherwise(LEVELS[-1])
    rows = zones.select(
        F.col(zone), F.col(ring).alias("_ring"), _edges(F.col(ring)).alias("_edges"), west.alias("_west"), south.alias("_south"),
        east.alias("_east"), north.alias("_north"),
        F.least(F.greatest(level, F.lit(LEVELS[0])), F.lit(LEVELS[-1] - cuts)).cast("int").alias("_level"),
    )
    size = F.lit(WIDEST) / F.pow(F.lit(2.0), F.col("_level"))
    span = lambda low, high: F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))
    pairs = F.flatten(F.transform(span("_west", "_east"), lambda x: F.transform(span("_south", "_north"), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    rows = rows.withColumn("_open", pairs)
    for k in range(cuts + 1):
        rows = _cut(rows, k, most, last=k == cuts)
    found = [f"_cells_{k}" for k in range(cuts + 1)]
    cells = rows.select(F.col(zone), F.explode(F.concat(*[F.col(c) for c in found])).alias("_cell"))
    return cells.select(zone, "_cell.*")


def points_in_zones(
    points: DataFrame, zones: DataFrame, zone: str, lon: str, lat: str, ring: str, cuts: int = CUTS, most: int = MOST_CELLS
) -> DataFrame:
    """Every (point, zone) with the point inside, with all columns of both but the ring; ``zone`` tells the zones apart.

    A point has one cell of each size that occurs.  Pairs from cells that lie inside
    are done; those from cells along the edge fetch the ring by zone and are tested.
    A zone's cells do not overlap, so no pair is found twice.
    """
    zones = checkpointed(zones)
    cells = checkpointed(cover(zones, zone, ring, cuts, most)).select(F.col(zone).alias("_zone"), "level", "cx", "cy", "inside")
    levels = [r["level"] for r in cells.select("level").distinct().collect()]  # at most one per size
    if not levels:
        levels = [0]
    sizes = [WIDEST / 2**k for k in levels]
    places = F.array(*[
        F.struct(F.lit(k).alias("_l"), F.floor(F.col(lon) / s).alias("_x"), F.floor(F.col(lat) / s).alias("_y"))
        for k, s in zip(levels, sizes, strict=True)
    ])
    placed = points.withColumn("_place", F.explode(places)).select(*points.columns, "_place.*")
    same = (F.col("_l") == F.col("level")) & (F.col("_x") == F.col("cx")) & (F.col("_y") == F.col("cy"))
    pairs = placed.join(cells, same).drop("_l", "_x", "_y", "level", "cx", "cy")
    sure = pairs.filter("inside").drop("inside").join(zones.drop(ring), F.col("_zone") == F.col(zone))
    open_ = pairs.filter("not inside").drop("inside").join(zones, F.col("_zone") == F.col(zone))
    tested = open_.filter(in_polygon(F.col(lon), F.col(lat), F.col(ring))).drop(ring)
    return sure.unionByName(tested).drop("_zone")


def points_outside_zones(
    points: DataFrame, zones: DataFrame, key: str, zone: str, lon: str, lat: str, ring: str
) -> DataFrame:
    """Points that lie in no zone."""
    inside = points_in_zones(points.select(key, lon, lat), zones.select(zone, ring), zone, lon, lat, ring)
    return without(points, inside, key)


def within_distance(
    points: DataFrame,
    centres: DataFrame,
    point_at: tuple[str, str],
    centre_at: tuple[str, str],
    metres: float,
    name: str,
) -> DataFrame:
    """Every (point, centre) no further apart than ``metres``, with the distance.

    Cells are as high as the radius.  A place of centres is listed in every cell its
    circle can touch (wider in longitude away from the equator), one of points has
    one cell.  Places are measured once, however many points and centres stand on
    them: only near places bring their points and centres together.
    """
    size = metres / METRES_PER_DEGREE
    lon, lat = F.col("_lon"), F.col("_lat")
    reach = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(size))) / F.cos(F.radians(lat)))))
    spread = (
        centres.select(*[F.col(c).alias(a) for c, a in zip(centre_at, ("_lon", "_lat"), strict=True)])
        .distinct()
        .withColumn("_reach", reach)
        .withColumn("_cx", _cells(lon - F.col("_reach"), lon + F.col("_reach"), size))
        .withColumn("_cy", _cells(lat - size, lat + size, size))
        .drop("_reach")
    )
    x, y = F.col("_x"), F.col("_y")
    places = points.select(*[F.col(c).alias(a) for c, a in zip(point_at, ("_x", "_y"), strict=True)]).distinct()
    placed = places.withColumns({"_cx": cell(x, size), "_cy": cell(y, size)})
    near = placed.join(spread, ["_cx", "_cy"]).withColumn(name, distance_m(x, y, lon, lat)).filter(F.col(name) <= metres)
    near = near.drop("_cx", "_cy")
    found = points.join(near, (F.col(point_at[0]) == x) & (F.col(point_at[1]) == y))
    met = found.join(centres, (lon == F.col(centre_at[0])) & (lat == F.col(centre_at[1])))
    return met.select(*points.columns, *centres.columns, name)
