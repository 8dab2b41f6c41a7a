"""Boolean tests under three-valued logic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_true(flag: Column) -> Column:
    """TRUE only for TRUE; never NULL."""
    return flag.eqNullSafe(F.lit(True))


def is_false(flag: Column) -> Column:
    """TRUE only for FALSE; never NULL."""
    return flag.eqNullSafe(F.lit(False))


def not_false(flag: Column) -> Column:
    """TRUE for TRUE and NULL."""
    return ~is_false(flag)
