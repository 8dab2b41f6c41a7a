"""Joins whose outer side, null handling or key needs care."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread_join(
    left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "left", null_keys: bool = False
) -> DataFrame:
    """Join many rows to a side that is aggregated by the join key, safe for frequent keys.

    A plain join would reuse the partitioning of the aggregate, and Spark splits
    a frequent key only if both sides come straight out of a shuffle of the
    join's own.  Comparing with null-safe equality keeps the two apart, at the
    price of one shuffle of the aggregate.  NULL keys have no partner, as in a
    plain join, unless ``null_keys`` is set: then NULL meets NULL.
    """
    keys = [on] if isinstance(on, str) else on
    partners = right if null_keys else right.dropna(subset=keys)
    renamed = partners.select(
        *[F.col(k).alias(f"_right_{k}") for k in keys], *[F.col(c) for c in right.columns if c not in keys]
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def left_join_where(
    left: DataFrame, right: DataFrame, on: list[str] | str, right_where: Column
) -> DataFrame:
    """Left join with extra conditions on the right side.

    The conditions belong to ON: they thin out the right side first, and no left
    row is lost.
    """
    return left.join(right.filter(right_where), on, "left")


def _keys_of(right: DataFrame, on: list[str] | str) -> DataFrame:
    """Keys of the right side, each once: repeated keys are combined before the shuffle."""
    return right.select(*([on] if isinstance(on, str) else on)).distinct()


def without(left: DataFrame, right: DataFrame, on: list[str] | str) -> DataFrame:
    """Rows of ``left`` that have no partner."""
    return spread_join(left, _keys_of(right, on), on, "left_anti")


def having(left: DataFrame, right: DataFrame, on: list[str] | str) -> DataFrame:
    """Rows of ``left`` that have a partner, each once."""
    return spread_join(left, _keys_of(right, on), on, "left_semi")


def band_join(
    intervals: DataFrame,
    events: DataFrame,
    keys: list[str],
    first: Column,
    last: Column,
    at: Column,
    band: int,
    how: str = "left",
) -> DataFrame:
    """Join events to the intervals ``[first, last]`` (dates) that hold them, on equal keys.

    Days are numbered and cut into bands of ``band`` days; an interval is listed
    once per band it touches, and the band is part of the hash key.  So the rows
    of one frequent key are spread over bands, and a row only meets intervals
    that start or end near it.  Every event has one band, so no pair is doubled.
    With ``how="left"`` an interval without events gives one row, whatever the
    number of its bands; equal intervals have the same events, so they are told
    apart by their columns alone.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown kind of join: {how}")
    epoch = F.lit("1970-01-01").cast("date")
    of_day = lambda date: F.floor(F.datediff(date, epoch) / band).cast("int")
    listed = intervals.withColumns({"_first": first, "_last": last}).withColumn(
        "_band",
        F.explode(F.when(F.col("_first") <= F.col("_last"), F.sequence(of_day(F.col("_first")), of_day(F.col("_last"))))),
    )
    placed = events.withColumns({"_at": at}).withColumn("_event_band", of_day(F.col("_at")))
    placed = placed.select(
        *[F.col(k).alias(f"_event_{k}") for k in keys],
        *[F.col(c) for c in placed.columns if c not in keys],
    )
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_event_{k}") for k in keys])
    on = on & (F.col("_band") == F.col("_event_band"))
    on = on & F.col("_at").between(F.col("_first"), F.col("_last"))
    met = listed.join(placed, on).drop("_first", "_last", "_band", "_at", "_event_band", *[f"_event_{k}" for k in keys])
    if how == "inner":
        return met
    columns = intervals.columns
    alone = spread_join(intervals, met.select(*columns).distinct(), columns, "left_anti", null_keys=True)
    return met.unionByName(alone, allowMissingColumns=True)
