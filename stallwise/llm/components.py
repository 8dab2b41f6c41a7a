"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.llm.folders import kept
from stallwise.operators.joins import spread_join


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of its neighbours."""
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.min("b").alias("least"))
    met = spread_join(near.filter(F.col("b") > F.col("a")), least, "a", "inner")
    return met.select(F.col("b").alias("a"), F.least("least", "a").alias("b")).filter(F.col("a") != F.col("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    met = spread_join(down, least, "a", "inner")
    tied = met.select(F.col("b").alias("a"), F.col("least").alias("b")).unionAll(least.select("a", F.col("least").alias("b")))
    return tied.filter(F.col("a") != F.col("b")).distinct()


def closer(edges: DataFrame) -> DataFrame:
    """The same components by other edges, most nodes tied to a smaller one they are connected with."""
    plain = edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct()
    return kept(_small_star(_large_star(plain)), "stars")


def components(edges: DataFrame) -> DataFrame:
    """The nodes of ``edges`` (columns ``a`` and ``b``, whole numbers) with the least node each is connected to.

    Large and small stars in turn, until nothing changes: each node then hangs
    on its least one.  Edges never grow in number, and no node's neighbours are
    gathered.  Nodes that are least of their component are not listed.
    """
    stars = kept(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    seen = None
    while True:
        stars = closer(stars)
        sums = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == seen:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("label"))
        seen = sums
