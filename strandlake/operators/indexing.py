"""Dense 0-based row indexes, without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.session import BROADCAST_ROWS, stage

INDEX = "_index"
_LOW = (1 << 33) - 1


def with_index(df: DataFrame, order_by: Sequence[str | Column] | None = None, name: str = INDEX, *, retain: bool = True, store: bool = True) -> DataFrame:
    """``df`` with a dense 0-based LONG index ``name``.

    An existing column of that name is kept as the index (``retain``) or replaced.  With ``order_by``
    rows are numbered in that order (range partitions, sorted each on its own); else in scan order.
    Each row's number is its place in its partition plus the rows of the partitions before; only one
    count per partition reaches the driver, and goes back as a table of one row per partition.
    ``store=False`` is for plain scans of files, whose rows are in the same places each time: they
    are read twice then instead of being stored.
    """
    if name in df.columns and retain:
        return df.withColumn(name, F.col(name).cast("long"))
    return numbered(df, order_by, name, store=store)[0]


def numbered(df: DataFrame, order_by: Sequence[str | Column] | None = None, name: str = INDEX, *, store: bool = True) -> tuple[DataFrame, int]:
    """:func:`with_index` with a new index, and the number of rows."""
    df = df.drop(name)
    if order_by is not None:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = df.withColumn("__place", F.monotonically_increasing_id())
    if store or order_by is not None:
        placed = stage(placed, "indexed")
    split = F.shiftright("__place", 33)
    counts = placed.groupBy(split.alias("p")).count().toArrow().sort_by("p")
    total = counts["count"].to_numpy()
    offsets = pa.table({"__split": counts["p"], "__before": pa.array(total.cumsum() - total)})
    few = len(total) <= BROADCAST_ROWS
    offsets = df.sparkSession.createDataFrame(offsets)
    rows = placed.withColumn("__split", split).join(F.broadcast(offsets) if few else offsets, "__split")
    return rows.withColumn(name, F.col("__before") + F.col("__place").bitwiseAND(F.lit(_LOW))).drop("__place", "__split", "__before"), int(total.sum())
