"""One text from the values of a group, however many they are.

The values of a group are put in order over range partitions (see ``pieces``).
Each piece joins its part of the group, which is as large as the piece at most,
and the parts, one per piece, are joined in order.  So no task gathers or sorts all
values of a group; only the text itself is in one row, and a bound says how long
it may be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.operators.joins import spread_join
from stallwise.operators.pieces import in_pieces

#: Characters of a text, unless the caller asks for more: what a row can well hold.
LONGEST = 64 << 20


def _in_order(place: str, text: str, separator: str) -> Column:
    entries = F.sort_array(F.collect_list(F.struct(place, text)))
    return F.array_join(F.transform(entries, lambda e: e[text]), separator)


def joined_text(
    df: DataFrame,
    keys: list[str],
    value: Column,
    order_by: list[Column],
    name: str,
    separator: str = ",",
    longest: int = LONGEST,
    pieces: int | None = None,
) -> DataFrame:
    """One row per group with its values in order as one text, as STRING_AGG gives it.

    Repeats are kept, NULL values are left out, and a group without values gives
    NULL.  Rows without a key are a group.  Equal places are ordered by the value.
    A text of more than ``longest`` characters is an error, told by the sum of
    lengths before any text is made.
    """
    rows = df.withColumn("_value", value.cast("string"))
    cut = in_pieces(rows, keys, [*order_by, F.col("_value").asc()], pieces).select(*keys, "_value", "_piece", "_place")
    sizes = cut.groupBy(*keys).agg(F.coalesce(F.sum(F.length("_value") + len(separator)), F.lit(0)).alias("_size"))
    if not sizes.filter(F.col("_size") - len(separator) > longest).isEmpty():
        raise ValueError(f"a text of more than {longest} characters")
    parts = cut.filter(F.col("_value").isNotNull()).groupBy(*keys, "_piece").agg(_in_order("_place", "_value", separator).alias("_part"))
    whole = parts.groupBy(*keys).agg(_in_order("_piece", "_part", separator).alias(name))
    return spread_join(sizes.select(*keys), whole, keys, "left", null_keys=True)
