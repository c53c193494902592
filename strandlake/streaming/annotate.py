"""Annotating a stream of intervals against a static table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.coords import CoordCol, get_coord_cols
from strandlake.operators.depth import merge_depth
from strandlake.session import maybe_broadcast, stage


def stream_as_bool(stream: DataFrame, table: DataFrame, name: str, distance: int = 0, col_names: CoordCol | tuple | str | None = None, bin_width: int = 1 << 14) -> DataFrame:
    """``stream`` with a boolean column: is there a row of ``table`` at most ``distance`` away.

    ``table`` is merged once and kept in bins; each row of the stream asks the bins it spans, so the
    join is an equi-join without state.  Rows of the stream must have a unique ``_index``; the
    result has one row for each row and bin that is hit, and one without a hit, so a sink takes the
    maximum per ``_index`` (``foreachBatch`` does that in :func:`hits_per_batch`).
    """
    cols = get_coord_cols(col_names)
    if distance < 0:
        raise ValueError("a stream is matched by distances from 0 on")
    padded = table.select(*[c.alias(n) for c, n in zip(cols.columns(), ("chrom", "pos", "end"), strict=True)])
    padded = padded.select("chrom", (F.col("pos") - distance).alias("pos"), (F.col("end") + distance).alias("end"))
    merged = merge_depth(padded, col_max_depth=None)
    bins = merged.select(F.col("chrom").alias("__c"), F.col("pos").alias("__p"), F.col("end").alias("__e"), F.explode(F.sequence(F.floor(F.col("pos") / bin_width), F.floor(F.col("end") / bin_width))).alias("__b"))
    bins = maybe_broadcast(stage(bins, "bins"))
    chrom, pos, end = cols.columns()
    asked = stream.withColumn("__q", F.explode_outer(F.when(end >= pos, F.sequence(F.floor(pos / bin_width), F.floor(end / bin_width)))))
    met = asked.join(bins, (chrom == F.col("__c")) & (F.col("__q") == F.col("__b")) & (F.col("__p") <= end) & (F.col("__e") >= pos), "left")
    return met.withColumn(name, F.col("__c").isNotNull()).drop("__q", "__b", "__c", "__p", "__e")


def hits_per_batch(batch: DataFrame, name: str, index: str = "_index") -> DataFrame:
    """One row per ``index`` of a micro-batch, true if any of its bins was hit."""
    return batch.groupBy(index).agg(F.max(name).alias(name))
