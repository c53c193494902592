"""Exact detection of hot keys and joins that no hot key slows down."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.session import bounded, maybe_broadcast, stage

#: A key is hot if it holds this share of all rows, and at least so many rows.
HOT_SHARE = 1 / 2000
HOT_ROWS = 4096


def hot_limit(n_rows: int, share: float = HOT_SHARE, least: int = HOT_ROWS) -> int:
    return max(int(n_rows * share), least)


def hot_keys(df: DataFrame, n_rows: int, limit: int, keys: Sequence[str] = ("k1", "k2")) -> DataFrame:
    """The keys (two long columns) with at least ``limit`` of the ``n_rows`` rows, and their count ``n``.

    A key with ``limit`` rows holds at least the share ``limit / n_rows`` of some input split, so each
    split counts its own rows and names only the keys that reach that share; the named keys are then
    counted exactly over all splits.  At most ``n_rows / limit`` keys come out.
    """
    share = limit / max(n_rows, 1)
    k1, k2 = keys

    def name_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            a, b = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            count = np.diff(np.r_[starts, len(a)])
            named = starts[count >= share * len(a)]
            yield pa.RecordBatch.from_arrays([pa.array(a[named]), pa.array(b[named])], names=["k1", "k2"])

    if limit > n_rows:  # no key can be hot
        return df.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.lit(0).cast("long").alias("n")).limit(0)
    named = stage(df.select(F.col(k1).alias("k1"), F.col(k2).alias("k2")).mapInArrow(name_keys, "k1 long, k2 long").distinct(), "named")
    rows = df.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"))
    return rows.join(maybe_broadcast(named), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit)


def attach(left: DataFrame, right: DataFrame, key: str, count: str, n_rows: int) -> DataFrame:
    """``left`` joined (inner) with ``right`` on ``key``, whatever the share of one key in ``left``.

    ``right`` has one row per key and, in ``count``, its number of rows in ``left`` (``n_rows`` in
    all).  Hot keys are at most ``n_rows / limit`` in number and are broadcast, so their rows in
    ``left`` stay where they are; the others meet by shuffle.
    """
    if bounded(right):
        return left.join(F.broadcast(right), key).drop(count)
    limit = hot_limit(n_rows)
    hot, cold = right.where(F.col(count) >= limit), right.where(F.col(count) < limit)
    hot_part = left.join(F.broadcast(hot), key)
    cold_part = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return hot_part.unionByName(cold_part).drop(count)
