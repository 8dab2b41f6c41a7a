"""Array to rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, array: Column | str, name: str) -> DataFrame:
    """One row per element; parents with an empty or NULL array are lost."""
    return df.withColumn(name, F.explode(array))


def unnest_outer(df: DataFrame, array: Column | str, name: str) -> DataFrame:
    """One row per element; parents with an empty or NULL array stay, element NULL."""
    return df.withColumn(name, F.explode_outer(array))


def unnest_outer_where(
    df: DataFrame, array: Column | str, keep: Callable[[Column], Column], name: str
) -> DataFrame:
    """Left join of a row with those of its own elements that satisfy ``keep``.

    Elements are filtered inside the array, so a parent none of whose elements
    qualifies still gives one row.
    """
    return df.withColumn(name, F.explode_outer(F.filter(array, keep)))


def unnest_product(
    df: DataFrame, first: Column | str, first_name: str, second: Column | str, second_name: str
) -> DataFrame:
    """Every pair of the elements of two arrays of the same row."""
    return unnest(unnest(df, first, first_name), second, second_name)


def unnest_path(df: DataFrame, *path: str) -> DataFrame:
    """Arrays of structs that hold arrays: one row per element of the last, the elements on the way beside it.

    ``path`` names the first array and then a field of its elements, and so on; each
    name becomes a column with the element.  Parents with an empty or NULL array are
    lost.  See ``sources.leaves`` for reading only the fields that are used.
    """
    out = unnest(df, F.col(path[0]), path[0])
    for above, name in zip(path, path[1:]):
        out = unnest(out, F.col(above)[name], name)
    return out
