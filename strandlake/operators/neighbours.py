"""The row after and before each row of a group, without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_next(df: DataFrame, keys: Sequence[str], order: str, value: str, *, step: int = 1024) -> DataFrame:
    """``df`` with ``next_<value>`` and ``is_first`` in the order of the integer column ``order``.

    Rows are sorted within ranges of ``step`` values of ``order`` only; across ranges one row per
    range is looked at.  Ties in ``order`` are taken in the order of ``value``.  Null keys form a
    group, as in any window; rows with a null ``order`` come first; an empty table stays empty.
    """
    ranged = df.withColumn("__range", F.coalesce(F.floor(F.col(order) / F.lit(step)).cast("long"), F.lit(-(2**62))))
    inside = Window.partitionBy(*keys, "__range").orderBy(F.col(order).asc_nulls_first(), value)
    rows = ranged.withColumn("__next", F.lead(value).over(inside)).withColumn("__rn", F.row_number().over(inside))
    ends = ranged.groupBy(*keys, "__range").agg(F.min(F.struct(F.col(order), F.col(value))).getField(value).alias("__head"))
    across = Window.partitionBy(*keys).orderBy("__range")
    ends = ends.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__r"), F.lead("__head").over(across).alias("__next_head"), F.row_number().over(across).alias("__nth"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    on = F.col("__range") == F.col("__r")
    for s in same:
        on = on & s
    joined = rows.join(ends, on)
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.coalesce("__next", "__next_head").alias(f"next_{value}"),
        ((F.col("__rn") == 1) & (F.col("__nth") == 1)).alias("is_first"),
    )
