"""Continuous periods and gaps of overlapping, nested, touching intervals.

Method: ``session_window`` with a row-specific duration merges overlapping sessions inside Spark's
own aggregation; touching periods are joined and gaps derived afterwards with ``lead``.

A group (track and chromosome, say) may hold a third of all rows, so sessions are built per tile of
coordinates, and only one row per tile is looked at per group: the largest end before the tile tells
which sessions of the tile go on with a period that began earlier.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.session import stage

#: Coordinates of a tile at least, and tiles per group at most; both bound what one task gets.
MIN_TILE = 1 << 14
MAX_TILES = 1 << 16
_MERGE_EARLY = "spark.sql.sessionWindow.merge.sessions.in.local.partition"


def _span(ticks: Column) -> Column:
    """A calendar interval of so many microseconds, exactly."""
    zero = F.lit(0)
    return F.make_interval(zero, zero, zero, zero, zero, zero, (ticks.cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))


def merge_periods(df: DataFrame, keys: Sequence[str], start: str = "pos", end: str = "end", tile: int | None = None) -> DataFrame:
    """``kind`` (``period`` or ``gap``), the keys, ``span_pos``, ``span_end``.

    Intervals are half-open integers.  Overlapping, nested and touching ones (end = start) form one
    period; an empty interval is an interval; the space between two neighbouring periods of a group
    is a gap.

    Defined cases: rows with a null key, start or end, or with end < start, do not count; repeated
    and tied rows change nothing; an empty table (or one without a row that counts) gives no rows;
    a group with one period has no gap; other columns are not read, whatever their names.
    ``tile`` is the width of a tile in coordinates; by default it follows from the range of all
    coordinates, and it never changes the result.  Coordinates must stay below 2**61.
    """
    spark = df.sparkSession
    k = [f"k{i}" for i in range(len(keys))]
    iv = df.select(*[F.col(f"`{c}`").alias(a) for a, c in zip(k, keys, strict=True)], F.col(f"`{start}`").cast("long").alias("s"), F.col(f"`{end}`").cast("long").alias("e"))
    iv = iv.where(" and ".join(f"{c} is not null" for c in [*k, "s", "e"]) + " and e >= s")
    if tile is None:
        low, high = iv.agg(F.min("s"), F.max("s")).first()
        tile = max(MIN_TILE, ((high or 0) - (low or 0)) // MAX_TILES + 1)

    # Ticks are microseconds: [2s, 2e+1) is never empty, meets a touching neighbour and no other.
    iv = iv.withColumn("tile", F.floor(F.col("s") / F.lit(tile)).cast("long"))
    window = F.session_window(F.timestamp_micros(F.col("s") * 2), _span((F.col("e") - F.col("s")) * 2 + 1))
    sessions = iv.groupBy(*k, "tile", window.alias("w")).agg(F.max("e").alias("e"))
    sessions = sessions.select(*k, "tile", F.expr("cast(unix_micros(w.start) / 2 as long)").alias("s"), "e")
    # while these are formed, sessions are merged before the shuffle too, so copies and piles of one place collapse early
    was = spark.conf.get(_MERGE_EARLY, None)
    spark.conf.set(_MERGE_EARLY, "true")
    try:
        sessions = stage(sessions, "sessions")
    finally:
        if was is None:
            spark.conf.unset(_MERGE_EARLY)
        else:
            spark.conf.set(_MERGE_EARLY, was)

    # One row per tile: the largest end before it.
    by_tile, group = Window.partitionBy(*k).orderBy("tile"), Window.partitionBy(*k)
    carry = sessions.groupBy(*k, "tile").agg(F.max("e").alias("tile_end")).withColumn("carry", F.max("tile_end").over(by_tile.rowsBetween(Window.unboundedPreceding, -1))).withColumn("last_end", F.max("tile_end").over(group))
    marked = sessions.join(carry, [*k, "tile"]).withColumn("begins", F.col("carry").isNull() | (F.col("s") > F.col("carry")))

    # What the next tile with a beginning says of the last period of an earlier tile.
    heads = marked.groupBy(*k, "tile", "carry", "last_end").agg(F.min(F.when(F.col("begins"), F.col("s"))).alias("first_begin"), F.max(F.when(~F.col("begins"), F.col("e"))).alias("head_end"))
    heads = heads.where("first_begin is not null").withColumn("closes", F.greatest("carry", "head_end"))
    heads = heads.select(*k, "tile", "last_end", F.lead("closes").over(by_tile).alias("close_next"), F.lead("first_begin").over(by_tile).alias("begin_next"))

    in_tile = Window.partitionBy(*k, "tile").orderBy("s")
    begun = marked.where("begins").select(*k, "tile", "s", "e", F.lead("s").over(in_tile).alias("next_s"))
    # A session that is the last of its tile may go on in later tiles.
    spans = begun.join(heads, [*k, "tile"]).select(
        *k,
        "s",
        F.when(F.col("next_s").isNotNull(), F.col("e")).otherwise(F.coalesce("close_next", "last_end")).alias("e"),
        F.coalesce("next_s", "begin_next").alias("next_s"),
    )
    both = F.array(F.struct(F.lit("period").alias("kind"), F.col("s").alias("a"), F.col("e").alias("b")), F.struct(F.lit("gap").alias("kind"), F.col("e").alias("a"), F.col("next_s").alias("b")))
    rows = spans.select(*k, F.explode(both).alias("x")).where("x.b is not null")
    return rows.select(F.col("x.kind").alias("kind"), *[F.col(a).alias(c) for a, c in zip(k, keys, strict=True)], F.col("x.a").alias("span_pos"), F.col("x.b").alias("span_end"))
