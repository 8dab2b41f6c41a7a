"""Work along an order that is cut into pieces of even size, however the keys are spread.

Rows are put in order of key and sort columns over range partitions, so one key
may fill many of them.  Each piece is worked on by itself, and what it needs of the
pieces before it (a count, a last value) is a small aggregate with one row per
piece and key.

The bounds of the pieces come from a sample that Spark takes when the rows are put
in order.  They must be the same wherever the pieces are looked at, so the rows are
written to the checkpoint folder once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.operators.joins import spread_join
from stallwise.session import checkpointed

BEFORE = (Window.unboundedPreceding, -1)


def in_pieces(df: DataFrame, keys: list[str], order_by: list[Column], pieces: int | None = None) -> DataFrame:
    """The rows with the number of their ``_piece`` and, in order, their ``_place`` in all of it.

    Places count up by one within a piece.  Rows that tie in everything are in any order.
    """
    n = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*[F.col(k).asc() for k in keys], *order_by]
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return checkpointed(ranged.withColumns({"_piece": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}))


def numbered_by_range(
    df: DataFrame, keys: list[str], order_by: list[Column], rank: str, pieces: int | None = None
) -> DataFrame:
    """Row number of every row within its key; a key may hold any share of the rows.

    A piece knows the places of its rows.  A key's number starts where its count in
    the earlier pieces ends, and the place of its first row in the piece is taken off.
    Rows without a key are one group.
    """
    cut = in_pieces(df, keys, order_by, pieces)
    counts = cut.groupBy("_piece", *keys).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(*BEFORE)  # a row per piece
    shift = F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1
    shifts = counts.select("_piece", *keys, shift.alias("_shift"))
    placed = spread_join(cut, shifts, ["_piece", *keys], null_keys=True)
    return placed.withColumn(rank, F.col("_place") + F.col("_shift")).drop("_piece", "_place", "_shift")


def as_of(
    facts: DataFrame,
    values: DataFrame,
    keys: list[str],
    at: str,
    since: str,
    take: dict[str, str],
    pieces: int | None = None,
) -> DataFrame:
    """Every fact with what was last known of its keys at its time: columns ``take`` (new name by name) of ``values``.

    Facts and values are put in one order, the values of a time before its facts.
    Within a piece the last value so far counts; where there is none, the last one
    of the pieces before it.  No row meets more than its neighbours, whatever the
    gaps, and there is no join on a range of times.

    A fact before the first value, without a time, or with a NULL key gets NULLs.
    Of several values of a key and time the greatest counts, by the columns taken.
    Facts are kept as they are, repeated ones too.
    """
    value = F.struct(*[F.col(c).alias(name) for c, name in take.items()])
    known = values.dropna(subset=[*keys, since])
    known = known.select(*keys, F.col(since).alias("_time"), F.lit(0).alias("_kind"), value.alias("_value"))
    kind = known.schema["_value"].dataType
    rows = facts.select(
        *keys, F.col(at).alias("_time"), F.lit(1).alias("_kind"), F.lit(None).cast(kind).alias("_value"), F.struct("*").alias("_fact")
    ).unionByName(known, allowMissingColumns=True)
    cut = in_pieces(rows, keys, [F.col("_time").asc(), F.col("_kind").asc(), F.col("_value").asc()], pieces)
    so_far = Window.partitionBy("_piece", *keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    here = cut.withColumn("_here", F.last("_value", ignorenulls=True).over(so_far)).filter(F.col("_kind") == 1)
    tails = cut.groupBy("_piece", *keys).agg(F.max_by("_value", F.when(F.col("_kind") == 0, F.col("_place"))).alias("_tail"))
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(*BEFORE)  # a row per piece
    carried = tails.select("_piece", *keys, F.last("_tail", ignorenulls=True).over(earlier).alias("_carried"))
    met = here.select("_piece", *keys, "_fact", "_here").join(carried, ["_piece", *keys], "left")
    found = F.coalesce("_here", "_carried")
    return met.withColumn("_found", found).select("_fact.*", *[F.col("_found")[name].alias(name) for name in take.values()])
