"""Interval joins: equal chromosome, and ranges that overlap, touch or lie near each other.

An inequality join is turned into an equi-join by bins in several levels: an interval belongs to the
level whose bins are at least as wide as it is, so it spans two bins there, however long it is.  A
pair meets at the coarser of its two levels, in the later of its two first bins - exactly once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.coords import CoordCol, get_coord_cols
from strandlake.operators.indexing import INDEX, with_index
from strandlake.session import BROADCAST_ROWS, stage

_STEP = 3  # bins of a level are 8 times as wide as those of the level before
_LEAST_BITS = 4
#: Rows from which a table is worth spreading over the cores before its pairs are formed.
SPREAD_ROWS = 10_000


def _bits(length: Column) -> Column:
    """The least b with length <= 2**b: a length's class, of which there are 64 at most."""
    return F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1)))


def _level_of(bits: int, width_bits: int) -> int:
    return max(0, -(-(bits - width_bits) // _STEP))


def _lengths(sides: list[tuple[DataFrame, Column]]) -> list[dict[int, int]]:
    """How many lengths of each class every side has: one pass, and a few rows for the driver."""
    classes = [df.select(F.lit(i).alias("side"), _bits(n).alias("bits")) for i, (df, n) in enumerate(sides)]
    out: list[dict[int, int]] = [{} for _ in sides]
    for r in reduce(DataFrame.unionAll, classes).groupBy("side", "bits").count().collect():
        out[r.side][r.bits] = r["count"]
    return out


def _binned(df: DataFrame, low: str, high: str, width_bits: int, places: Column, side: str) -> DataFrame:
    """One row per bin that the interval has in each of ``places`` (kind of meeting, level)."""
    at = df.withColumn("__at", F.explode(places)).select("*", "__at.*").drop("__at", "__lv")
    shift = F.expr(f"shiftleft(1L, {width_bits} + __l * {_STEP})")
    at = at.withColumn(f"__first_{side}", F.floor(F.col(low) / shift)).withColumn("__last", F.floor(F.col(high) / shift))
    return at.withColumn("__bin", F.explode(F.sequence(f"__first_{side}", "__last"))).drop("__last")


def range_candidates(a: DataFrame, b: DataFrame, keys: list[str], low: tuple[str, str], high: tuple[str, str], bin_width: int | None = None, by_longer: bool = False, parts: int | None = None) -> DataFrame:
    """All pairs of ``a`` and ``b`` with equal ``keys`` whose closed ranges [low, high] may meet, each once.

    Every pair that meets is there; some others may be, so the caller applies its exact predicate.
    Column names of both sides (but for the keys) must differ.  Rows with a null bound or key, or
    with high < low, are in no pair.  Bins follow the median length of both sides together, or with
    ``by_longer`` that of the side with the longer ranges: where sides differ, half of that side would
    else lie in the wide bins of the next level.  ``parts`` is how many tasks form the pairs of tables
    that are not very small.
    """
    for_a = a.where(F.col(low[0]).isNotNull() & (F.col(high[0]) >= F.col(low[0])))
    for_b = b.where(F.col(low[1]).isNotNull() & (F.col(high[1]) >= F.col(low[1])))
    n_a, n_b = F.col(high[0]) - F.col(low[0]), F.col(high[1]) - F.col(low[1])
    classes = _lengths([(for_a, n_a), (for_b, n_b)])
    if bin_width is None:  # the class of the median length
        width_bits = _LEAST_BITS
        for some in [[c] for c in classes] if by_longer else [classes]:
            both = sorted((k, n) for c in some for k, n in c.items())
            half, seen = sum(n for _, n in both) / 2, 0
            for k, n in both:
                seen += n
                if seen >= half:
                    width_bits = max(width_bits, k)
                    break
    else:
        width_bits = max(0, (max(1, bin_width) - 1).bit_length())
    levels_a, levels_b = (sorted({_level_of(k, width_bits) for k in c}) for c in classes)
    level = lambda n: F.greatest(F.lit(0), F.ceil((_bits(n) - width_bits) / F.lit(_STEP))).cast("int")
    place = lambda kind, lv: F.struct(F.lit(kind).alias("__kind"), lv.cast("int").alias("__l"))
    lv = F.col("__lv")
    listed = lambda kind, levels, keep: F.transform(F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), keep), lambda x: place(kind, x))
    # kind 0, b not longer than a: they meet at a's level; kind 1, b longer: at b's level
    # (a row is left out of its own level where no row of the other side can meet it there)
    own = lambda kind, least: F.filter(F.array(place(kind, lv)), lambda x: x["__l"] >= F.lit(least))
    in_a = F.concat(own(0, min(levels_b, default=0)), listed(1, levels_b, lambda x: x > lv))
    in_b = F.concat(own(1, min(levels_a, default=0) + 1), listed(0, levels_a, lambda x: x >= lv))
    binned_a = _binned(for_a.withColumn("__lv", level(n_a)), low[0], high[0], width_bits, in_a, "a")
    binned_b = _binned(for_b.withColumn("__lv", level(n_b)), low[1], high[1], width_bits, in_b, "b")
    on = [*keys, "__kind", "__l", "__bin"]
    if parts and sum(n for c in classes for n in c.values()) > SPREAD_ROWS:
        binned_a, binned_b = binned_a.repartition(parts, *on), binned_b.repartition(parts, *on)
    elif SPREAD_ROWS < sum(classes[0].values()) <= BROADCAST_ROWS:
        # a small table is one split or few, but its pairs may be very many: its bins are spread over the cores
        binned_a = binned_a.repartition(*on)
    pairs = binned_a.join(binned_b, on).where(F.col("__bin") == F.greatest("__first_a", "__first_b"))
    return pairs.drop("__kind", "__l", "__bin", "__first_a", "__first_b")


def _side(df: DataFrame, cols: CoordCol, suffix: str) -> DataFrame:
    """Index and coordinates only: numbering stores the table once, so it must not be wide."""
    chrom, pos, end = cols.columns()
    own = [F.col(INDEX)] if INDEX in df.columns else []
    narrow = df.select(*own, chrom.alias("chrom"), pos.cast("long").alias(f"pos_{suffix}"), end.cast("long").alias(f"end_{suffix}"))
    return with_index(narrow).withColumnRenamed(INDEX, f"index_{suffix}")


def pairwise_join(
    df_a: DataFrame,
    df_b: DataFrame,
    distance: int = 0,
    col_names_a: CoordCol | tuple | str | None = None,
    col_names_b: CoordCol | tuple | str | None = None,
    *,
    bin_width: int | None = None,
) -> DataFrame:
    """All pairs of intervals on one chromosome at most ``distance`` apart (touching is 0 apart).

    Columns: ``index_a, index_b, chrom, pos, end, distance``; pos and end are the ends of what lies
    between (or is shared), distance is negative for an overlap.  A negative ``distance`` asks for an
    overlap of at least its size.  Rows are named by ``_index`` if there is such a column, else by
    their place in the table.

    Defined cases: rows with a null coordinate, or with end < pos, are in no pair; empty intervals
    are points; repeated rows pair each on its own; empty tables give no rows; ``bin_width`` never
    changes the result.
    """
    a, b = _side(df_a, get_coord_cols(col_names_a), "a"), _side(df_b, get_coord_cols(col_names_b), "b")
    pad = max(distance, 0)
    b = b.withColumn("low_b", F.col("pos_b") - pad).withColumn("high_b", F.col("end_b") + pad).where("end_b >= pos_b")
    met = range_candidates(a, b, ["chrom"], ("pos_a", "low_b"), ("end_a", "high_b"), bin_width)
    met = met.where((F.col("pos_b") - distance <= F.col("end_a")) & (F.col("end_b") + distance >= F.col("pos_a")))
    inner, outer = F.greatest("pos_a", "pos_b"), F.least("end_a", "end_b")
    return met.select("index_a", "index_b", "chrom", F.least(inner, outer).alias("pos"), F.greatest(inner, outer).alias("end"), (inner - outer).alias("distance"))


def pairwise_join_iter(df_a: DataFrame, df_b: DataFrame, distance: int = 0, col_names_a: CoordCol | tuple | str | None = None, col_names_b: CoordCol | tuple | str | None = None) -> Iterator[DataFrame]:
    """:func:`pairwise_join` as one frame per chromosome of ``df_a`` (at least one, maybe empty, frame)."""
    joined = stage(pairwise_join(df_a, df_b, distance, col_names_a, col_names_b), "joined")
    chrom = get_coord_cols(col_names_a).columns()[0]
    names = sorted(r[0] for r in df_a.select(chrom).where(chrom.isNotNull()).distinct().toLocalIterator())
    if not names:
        yield joined
    for name in names:
        yield joined.where(F.col("chrom") == name)
