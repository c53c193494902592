"""Per row of one table: is it hit by another table, and what share of it is covered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.coords import CoordCol, get_coord_cols
from strandlake.operators.depth import merge_depth
from strandlake.operators.indexing import INDEX, with_index
from strandlake.operators.interval_join import pairwise_join
from strandlake.session import stage


def _named(name: str) -> str:
    if not isinstance(name, str) or not name.strip():
        raise ValueError("the name of the new column is blank")
    if name == INDEX:
        raise ValueError(f"the new column must not be named {INDEX}")
    return name.strip()


def _numbered(df: DataFrame, cols: CoordCol) -> DataFrame:
    own = [F.col(INDEX)] if INDEX in df.columns else []
    return with_index(df.select(*own, *cols.columns()))


def _islands(df: DataFrame, cols: CoordCol, pad: int) -> DataFrame:
    """The padded intervals, merged and stored, as the join looks at them several times.

    Their index is unique, which is all a join needs here.
    """
    chrom, pos, end = cols.columns()
    padded = df.select(chrom.alias("chrom"), (pos.cast("long") - pad).alias("pos"), (end.cast("long") + pad).alias("end")).where("`end` >= pos")
    return stage(merge_depth(padded, col_max_depth=None, sort=False).withColumn(INDEX, F.monotonically_increasing_id()), "islands")


def _outermost(df: DataFrame, cols: CoordCol, pad: int, tile: int = 1 << 14) -> DataFrame:
    """The padded intervals without most of those that lie within another: enough to say what is hit.

    Of equal starts the longest stays; within a tile of starts, which has ``tile`` rows at most then,
    what ends no later than an earlier one goes.
    """
    chrom, pos, end = cols.columns()
    longest = df.select(chrom.alias("chrom"), (pos.cast("long") - pad).alias("pos"), (end.cast("long") + pad).alias("end")).where("chrom is not null and `end` >= pos").groupBy("chrom", "pos").agg(F.max("end").alias("end"))
    earlier = Window.partitionBy("chrom", F.floor(F.col("pos") / F.lit(tile))).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    outer = longest.withColumn("__reach", F.max("end").over(earlier)).where("__reach is null or `end` > __reach").drop("__reach")
    return stage(outer.withColumn(INDEX, F.monotonically_increasing_id()), "outermost")


def as_bool(
    df_a: DataFrame,
    df_b: DataFrame,
    name: str,
    distance: int = 0,
    negate: bool = False,
    col_names_a: CoordCol | tuple | str | None = None,
    col_names_b: CoordCol | tuple | str | None = None,
) -> DataFrame:
    """``_index`` and ``name``: whether the row of ``df_a`` has a match in ``df_b`` (or has none: ``negate``).

    What a match is, :func:`~strandlake.operators.interval_join.pairwise_join` says.  For distances
    from 0 on, what lies within another row of ``df_b`` is left out first, so a pile is met once.  A row of ``df_a`` with a
    null coordinate has no match; no row is lost or repeated.
    """
    name, cols_a, cols_b = _named(name), get_coord_cols(col_names_a), get_coord_cols(col_names_b)
    a = _numbered(df_a, cols_a)
    if distance >= 0:
        hits = pairwise_join(a, _outermost(df_b, cols_b, distance), 0, cols_a)
    else:
        hits = pairwise_join(a, df_b, distance, cols_a, cols_b)
    hit = hits.select(F.col("index_a").alias(INDEX)).distinct().withColumn("__hit", F.lit(True))
    value = F.coalesce("__hit", F.lit(False))
    return a.select(INDEX).join(hit, INDEX, "left").select(INDEX, (~value if negate else value).alias(name))


def as_proportion(
    df_a: DataFrame,
    df_b: DataFrame,
    name: str,
    col_names_a: CoordCol | tuple | str | None = None,
    col_names_b: CoordCol | tuple | str | None = None,
) -> DataFrame:
    """``_index`` and ``name``: the share of the row of ``df_a`` that ``df_b`` covers, counted once.

    Without a match 0; with a null coordinate null; an empty interval gives NaN.
    """
    name, cols_a, cols_b = _named(name), get_coord_cols(col_names_a), get_coord_cols(col_names_b)
    a = _numbered(df_a, cols_a)
    covered = pairwise_join(a, _islands(df_b, cols_b, 0), 0, cols_a).where("distance < 0").groupBy(F.col("index_a").alias(INDEX)).agg(F.sum(F.col("end") - F.col("pos")).alias("__bp"))
    chrom, pos, end = cols_a.columns()
    length = end.cast("double") - pos.cast("double")
    known = chrom.isNotNull() & pos.isNotNull() & end.isNotNull()
    value = F.when(known, F.when(length == 0, F.lit(float("nan"))).otherwise(F.coalesce("__bp", F.lit(0)) / F.when(length != 0, length)))
    return a.join(covered, INDEX, "left").select(INDEX, value.alias(name))
