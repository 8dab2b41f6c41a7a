"""Distinct counts that add up: exact sets of ids as bitmaps.

Counts of distinct ids cannot be added: who orders on Monday and on Tuesday is one
customer of the week.  Sets can.  The ids of a group are kept as bitmaps of 64 ids
each, a long per set; sets of days are united into sets of weeks, months or places
without another look at the facts, and their bits are counted.

Ids are whole numbers.  A group takes one row of longs for every 64 numbers in which
it has any: at most one row per id, where ids lie far apart, and one per 64 where
they lie close.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Which 64 numbers a bitmap holds.
BUCKET = "_bucket"


def id_sets(df: DataFrame, keys: list[str], ident: str, conditions: dict[str, Column]) -> DataFrame:
    """Per group and range of ids, the set of the ids of the rows that meet each condition; NULL for an empty set.

    All sets come from one pass over the rows, combined before the shuffle.  NULL ids
    are in no set, and rows without a key are a group.
    """
    number = F.col(ident).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(63).cast("int"))
    rows = df.filter(F.col(ident).isNotNull()).withColumns({BUCKET: F.shiftright(number, 6), "_bit": bit})
    # bit_or ignores NULL.
    sets = [F.bit_or(F.when(condition, F.col("_bit"))).alias(name) for name, condition in conditions.items()]
    return rows.groupBy(*keys, BUCKET).agg(*sets)


def united(sets: DataFrame, keys: list[Column | str], names: list[str]) -> DataFrame:
    """Sets of larger groups, such as weeks made of days."""
    return sets.groupBy(*keys, BUCKET).agg(*[F.bit_or(name).alias(name) for name in names])


def sizes(sets: DataFrame, keys: list[Column | str], names: list[str]) -> DataFrame:
    """How many ids each set of a group has, over all ranges of ids."""
    return sets.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.bit_count(name).cast("long")), F.lit(0).cast("long")).alias(name) for name in names]
    )
