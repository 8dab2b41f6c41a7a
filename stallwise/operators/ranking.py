"""First, latest and top rows per key; running totals; row numbers of long groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.operators.joins import spread_join


def top_per_key(df: DataFrame, keys: list[str], order_by: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in the given order.

    The filter on the row number lets Spark limit each key to ``n`` rows in every
    map task before the shuffle, so a frequent key costs one task no more than
    ``n`` rows from each of the others.
    """
    place = rank or "_place"
    ranked = df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by)))
    kept = ranked.filter(F.col(place) <= n)
    return kept if rank else kept.drop(place)


def first_per_key(df: DataFrame, keys: list[str], order_by: list[Column]) -> DataFrame:
    return top_per_key(df, keys, order_by, 1)


def with_first_flag(df: DataFrame, keys: list[str], order_by: list[str], flag: str) -> DataFrame:
    """Every row, marked whether it is the first of its key by the given columns.

    The first row is found by an aggregate, so no key is gathered; the columns
    should tell the rows of a key apart, or all rows that tie are marked.
    """
    place = F.struct(*order_by)
    first = df.groupBy(*keys).agg(F.min(place).alias("_first"))
    return spread_join(df, first, keys, null_keys=True).withColumn(flag, place == F.col("_first")).drop("_first")


def running_by_step(df: DataFrame, keys: list[str], step: str, **aggregates: Column) -> DataFrame:
    """Running sums per key over a calendar-like column, one row per (key, step).

    Rows are summed per step first.  The window then sees no more rows of a key
    than the column has values, and rows of the same step share the value, as
    under the default RANGE frame.
    """
    per_step = df.groupBy(*keys, step).agg(*[agg.alias(name) for name, agg in aggregates.items()])
    so_far = Window.partitionBy(*keys).orderBy(step)
    return per_step.select(
        *keys, step, *[F.sum(name).over(so_far).alias(name) for name in aggregates]
    )


def with_running(df: DataFrame, keys: list[str], step: str, **aggregates: Column) -> DataFrame:
    """Running sums beside every row; rows of one step share the value."""
    return spread_join(df, running_by_step(df, keys, step, **aggregates), [*keys, step], null_keys=True)


def numbered(
    df: DataFrame,
    keys: list[str],
    order_by: list[Column],
    chunk: Column,
    rank: str,
    descending: bool = False,
    null_keys: bool = True,
) -> DataFrame:
    """Row number of every row within its key, without gathering a key in one task.

    ``chunk`` is any non-decreasing function of the leading sort column, such as
    its month.  Rows are numbered inside (key, chunk) and shifted by the number
    of rows in the chunks before, which comes from a small count.  Rows without
    a key are one group.  Without ``null_keys`` they stay unnumbered, and the
    shift is joined on the partitioning of the numbering, a shuffle less.
    """
    cut = df.withColumn("_chunk", chunk)
    order = F.col("_chunk").desc() if descending else F.col("_chunk").asc()
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        cut.groupBy(*keys, "_chunk")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_shift", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order_by)
    local = cut.withColumn(rank, F.row_number().over(inside))
    at = [*keys, "_chunk"]
    placed = spread_join(local, shift, at, null_keys=True) if null_keys else local.join(shift, at, "left")
    return placed.withColumn(rank, (F.col(rank) + F.col("_shift")).cast("long")).drop("_chunk", "_shift")


def pair_by_rank(left: DataFrame, right: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """The n-th row of one numbered set beside the n-th of the other, per key."""
    return left.join(right, [*keys, rank], "left")
