"""Aggregate expressions and group-level helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.operators.joins import spread_join


def count_where(condition: Column) -> Column:
    """Rows for which the condition holds."""
    return F.count_if(condition)


def count_distinct_where(condition: Column, value: Column | str) -> Column:
    """Distinct values among the rows for which the condition holds."""
    value = F.col(value) if isinstance(value, str) else value
    return F.count_distinct(F.when(condition, value))


def sum_where(condition: Column, value: Column, otherwise: Column | None = None) -> Column:
    picked = F.when(condition, value)
    return F.sum(picked if otherwise is None else picked.otherwise(otherwise))


def per_id_flags(df: DataFrame, group: list[str], ident: list[str] | str, flags: dict[str, Column]) -> DataFrame:
    """One row per (group, id), each flag telling whether any of its rows had it.

    A count of ids per flag is then a plain conditional count.  Many conditional
    distinct counts over the same id would instead replicate every input row
    once per count before the shuffle.
    """
    ids = [ident] if isinstance(ident, str) else ident
    any_of = {name: F.coalesce(F.bool_or(flag), F.lit(False)).alias(name) for name, flag in flags.items()}
    return df.groupBy(*group, *ids).agg(*any_of.values())


def with_group_totals(
    df: DataFrame, keys: list[str], *, null_keys: bool = True, **aggregates: Column
) -> DataFrame:
    """Group aggregates beside every row of the group.

    Aggregate, then join back: the aggregate is combined before its shuffle and a
    frequent key is split by the skew-join rule, whereas a window would hold all
    rows of a key in one task.  As under PARTITION BY, rows without a key form a
    group too, unless ``null_keys`` is off.
    """
    totals = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggregates.items()])
    return spread_join(df, totals, keys, null_keys=null_keys)


def repeated_keys(df: DataFrame, keys: list[str], name: str = "copies") -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) > 1)


def ordered_text(value: Column, order_by: list[Column], separator: str = ",", distinct: bool = False) -> Column:
    """Aggregate: the values of a group as one ordered, separated string, as STRING_AGG gives it.

    Repeats are kept unless ``distinct`` is set, NULLs are left out, and a group
    without values gives NULL.  A group's text holds all its values, so it is for
    groups whose text one row can hold; distinct values are combined before the
    shuffle.
    """
    entry = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order_by)], value.alias("value"))
    gather = F.collect_set if distinct else F.collect_list
    entries = F.array_sort(gather(F.when(value.isNotNull(), entry)))
    text = F.array_join(F.transform(entries, lambda e: e["value"]), separator)
    return F.when(F.count(value) > 0, text)
