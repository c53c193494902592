"""Measures of a pair of intervals or variants, as expressions over ``_a`` and ``_b`` columns.

Measures are FLOAT, and ratios are guarded: 0/0 is NaN, x/0 is infinite, as in IEEE arithmetic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F



def _nan() -> Column:
    return F.lit(float("nan"))


def f32(value: float) -> Column:
    """A threshold as FLOAT, so that 0.7 as FLOAT reaches 0.7."""
    return F.lit(float(value)).cast("float")


def ratio(num: Column, den: Column) -> Column:
    """num / den as DOUBLE; den is not negative. Each expression stands in it once or twice only, as the
    code of a join's condition must stay small."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.when(num == 0, _nan()).otherwise(F.signum(num) * F.lit(math.inf)))


def _lengths_known(value: Column) -> Column:
    """Null where a length is: ``least`` and ``greatest`` would take the other side's."""
    return F.when(F.col("varlen_a").isNotNull() & F.col("varlen_b").isNotNull(), value).cast("float")


def reciprocal_overlap() -> Column:
    """Shared length over the larger length, between 0 and 1; NaN if both lengths are 0, null if one is null."""
    shared = F.least("_end_ro_a", "_end_ro_b") - F.greatest("pos_a", "pos_b")
    larger = F.greatest("varlen_a", "varlen_b")
    value = F.greatest(F.least(F.try_divide(shared.cast("double"), larger.cast("double")), F.lit(1.0)), F.lit(0.0))
    return _lengths_known(F.when(larger == 0, _nan()).otherwise(value))


def size_reciprocal() -> Column:
    """Smaller length over larger length; null if one is null."""
    return _lengths_known(ratio(F.least("varlen_a", "varlen_b"), F.greatest("varlen_a", "varlen_b")))


def offset() -> Column:
    """The larger of the distances between starts and between ends."""
    return F.greatest(F.abs(F.col("pos_a") - F.col("pos_b")), F.abs(F.col("end_a") - F.col("end_b")))


def offset_distance() -> Column:
    """:func:`offset` as INT."""
    return offset().cast("int")


def offset_proportion() -> Column:
    """Offset distance over the smaller length; null if a length is."""
    return _lengths_known(ratio(offset(), F.least("varlen_a", "varlen_b")))


def at_least(value: Column, limit: float) -> Column:
    """``value >= limit`` as FLOAT; NaN is not."""
    return F.nanvl(value, F.lit(-math.inf).cast("float")) >= f32(limit)


def at_most(value: Column, limit: float) -> Column:
    """``value <= limit`` as FLOAT; NaN, which is above all numbers, is not."""
    return value <= f32(limit)
