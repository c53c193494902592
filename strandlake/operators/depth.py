"""Sweep-line depth of intervals, and the merging of overlapping ones.

Events are aggregated per position first, and running totals are formed in two levels (tiles of
coordinates, then positions within a tile), so no chromosome is swept by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.coords import CoordCol, get_coord_cols

TILE = 1 << 17


def running_before(df: DataFrame, group: str, order: str, values: dict[str, Column], tile: int = TILE) -> DataFrame:
    """``df`` with, for each name in ``values``, the sum of its value over the rows before in the group."""
    tiled = df.select("*", *[v.alias(f"__v_{n}") for n, v in values.items()]).withColumn("__tile", F.floor(F.col(order) / F.lit(tile)))
    in_tile = Window.partitionBy(group, "__tile").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    over_tiles = Window.partitionBy(group).orderBy("__tile").rowsBetween(Window.unboundedPreceding, -1)
    rows = tiled.select("*", *[F.coalesce(F.sum(f"__v_{n}").over(in_tile), F.lit(0)).alias(f"__in_{n}") for n in values])
    sums = tiled.groupBy(group, "__tile").agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in values])
    sums = sums.select(group, "__tile", *[F.coalesce(F.sum(f"__s_{n}").over(over_tiles), F.lit(0)).alias(f"__t_{n}") for n in values])
    out = rows.join(sums, [group, "__tile"])
    return out.select(*df.columns, *[(F.col(f"__in_{n}") + F.col(f"__t_{n}")).alias(n) for n in values])


def _positions(df: DataFrame, cols: CoordCol, distance: int = 0) -> DataFrame:
    """Per (g, loc): how many intervals start and end there, and the depth ``before`` it."""
    g, s, e = cols.columns()
    valid = df.select(g.alias("g"), s.cast("long").alias("s"), (e.cast("long") + distance).alias("e")).where("g is not null and s is not null and e is not null")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    events = valid.select("g", F.explode(F.array(F.struct(F.col("s").alias("loc"), one.alias("up"), none.alias("down")), F.struct(F.col("e").alias("loc"), none.alias("up"), one.alias("down")))).alias("x"))
    at = events.groupBy("g", F.col("x.loc").alias("loc")).agg(F.sum("x.up").alias("up"), F.sum("x.down").alias("down"))
    return running_before(at, "g", "loc", {"before": F.col("up") - F.col("down")})


def melt_depth(df: DataFrame, col_names: CoordCol | tuple | str | None = None, col_loc: str = "_loc", col_depth: str = "_depth") -> DataFrame:
    """Chromosome, location and depth at every change: one row per start, two per end (before, after).

    At one location starts come before ends, so touching intervals go up and down.  Rows come in no
    particular order; sorting by chromosome, location and, at a location, the order given by the
    running sum restores the sweep.  Rows with a null coordinate do not count; repeated rows count
    each; an empty table gives no rows.
    """
    cols = get_coord_cols(col_names)
    if col_loc in cols or col_depth in cols or col_loc == col_depth:
        raise AssertionError(f"columns {col_loc!r} and {col_depth!r} collide with each other or with {tuple(cols)}")
    up, down, before = F.col("up"), F.col("down"), F.col("before")
    peak = before + up
    ups = F.transform(F.sequence(F.lit(1).cast("long"), up), lambda i: before + i)
    downs = F.transform(F.sequence(F.lit(1).cast("long"), down), lambda i: peak - i)
    none = F.array().cast("array<bigint>")
    depths = F.concat(F.when(up > 0, ups).otherwise(none), F.array_repeat(peak, down.cast("int")), F.when(down > 0, downs).otherwise(none))
    return _positions(df, cols).select(F.col("g").alias(cols.chrom), F.col("loc").alias(col_loc), F.explode(depths).alias(col_depth))


def merge_depth(df: DataFrame, distance: int = 0, col_names: CoordCol | tuple | str | None = None, col_max_depth: str | None = "max_depth", *, sort: bool = True) -> DataFrame:
    """Overlapping, touching or up to ``distance`` apart intervals as one, with their largest depth.

    Depth is that of the intervals padded by ``distance`` (touching counts as 2).  Sorted by
    coordinates unless ``sort`` says not to.  ``col_max_depth=None`` leaves the depth out.  Rows with a null coordinate do not
    count; a group of equal rows has their number as depth; an empty table gives no rows.
    """
    cols = get_coord_cols(col_names)
    if col_max_depth is not None and col_max_depth in cols:
        raise ValueError(f"column {col_max_depth!r} is one of the coordinates {tuple(cols)}")
    if distance < 0:
        raise ValueError("distance must not be negative")
    at = _positions(df, cols, distance).withColumn("opens", (F.col("before") == 0).cast("long"))
    island = running_before(at, "g", "loc", {"earlier": F.col("opens")}).withColumn("island", F.col("earlier") + F.col("opens"))
    merged = island.groupBy("g", "island").agg(F.min("loc").alias("s"), (F.max("loc") - distance).alias("e"), F.max(F.col("before") + F.col("up")).alias("d"))
    out = [F.col("g").alias(cols.chrom), F.col("s").alias(cols.pos), F.col("e").alias(cols.end)]
    if col_max_depth is not None:
        out.append(F.col("d").alias(col_max_depth))
    return (merged.orderBy("g", "s", "e") if sort else merged).select(*out)
