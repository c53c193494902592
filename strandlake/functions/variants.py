"""Identifiers, order and provenance of variants, as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.indexing import with_index


def id_snv() -> Column:
    """``chrom-(pos+1)-SNV-REFALT``; null if a part is."""
    return F.concat(F.col("chrom"), F.lit("-"), (F.col("pos") + 1).cast("string"), F.lit("-SNV-"), F.upper("ref"), F.upper("alt"))


def id_nonsnv() -> Column:
    """``chrom-(pos+1)-VARTYPE-varlen``; null if a part is."""
    return F.concat(F.col("chrom"), F.lit("-"), (F.col("pos") + 1).cast("string"), F.lit("-"), F.upper("vartype"), F.lit("-"), F.col("varlen").cast("string"))


def variant_id(columns: Sequence[str] | None = None) -> Column:
    """The identifier by variant type; ``columns`` names what the table has, if that is not all."""
    have = set(columns) if columns is not None else {"ref", "alt", "varlen"}
    snv = id_snv() if {"ref", "alt"} <= have else F.lit(None).cast("string")
    other = id_nonsnv() if "varlen" in have else F.lit(None).cast("string")
    return F.when(F.upper("vartype") == "SNV", snv).otherwise(other)


def sort_columns(columns: Sequence[str]) -> list[Column]:
    """The canonical order: chrom, pos, end, number of filters, id (as far as the table has them)."""
    out = [F.col("chrom").asc(), F.col("pos").asc(), F.col("end").asc()]
    if "filter" in columns:
        out.append(F.size("filter").asc())
    if "id" in columns:
        out.append(F.col("id").asc())
    return out


def lead_source(sources: str = "mg_src", lead: str = "mg_src_lead", alias: str = "lead_src") -> Column:
    """The entry of ``sources`` at the 0-based place ``lead``; null if there is none."""
    return F.get(F.col(sources), F.col(lead).cast("int")).alias(alias)


def default_id(index: str) -> Column:
    """``id``, or ``var<index>`` where it is null."""
    return F.coalesce(F.col("id").cast("string"), F.concat(F.lit("var"), F.col(index).cast("string")))


def version_ids(df: DataFrame, id_col: str = "id", tie: Sequence[str | Column] = (), order_col: str = "filter", hot_rows: int = 100_000, ids: DataFrame | None = None) -> DataFrame:
    """Makes ids unique: trailing ``.<number>`` is cut off, then repetitions get ``.1``, ``.2``, ...

    The order within an id is that of ``order_col`` (null first), then ``tie``; give a ``tie`` that
    decides, if runs are to agree.  A null id stays null.  Ids of more than ``hot_rows`` rows (blank
    ones, say) are ranked by ranges of their order instead of in one task; the result is the same.
    ``ids`` is a table with all ids of ``df`` (and maybe more) that is cheaper to count, if there is one.
    """
    base = F.regexp_replace(F.col(id_col), r"\.[0-9]*$", "")
    order = ([F.col(order_col).asc_nulls_first()] if order_col in df.columns else []) + list(tie)
    based = df.withColumn("__base", base)
    counts = (based if ids is None else ids.select(base.alias("__base"))).where("__base is not null").groupBy("__base").count().where(F.col("count") > hot_rows)
    # the largest of them: any other has less than 1/1000 of all rows
    hot = [r[0] for r in counts.orderBy(F.desc("count")).limit(1000).select("__base").collect()]
    is_hot = F.col("__base").isin(hot) if hot else F.lit(False)
    # null ids need no order: each is a group of its own
    window = Window.partitionBy("__base", "__spread").orderBy(*(order or [F.lit(0)]))
    spread = F.when(F.col("__base").isNull(), F.monotonically_increasing_id())
    cold = based.where(F.col("__base").isNull() | ~is_hot) if hot else based
    ranked = cold.withColumn("__spread", spread).withColumn("__n", F.row_number().over(window) - 1).drop("__spread")
    if hot:
        placed = with_index(based.where(is_hot), ["__base", *(order or [F.lit(0)])], "__at").withColumn("__range", F.floor(F.col("__at") / F.lit(hot_rows)))
        first = Window.partitionBy("__base")
        starts = placed.groupBy("__base", "__range").agg(F.min("__at").alias("__from")).withColumn("__from", F.min("__from").over(first))
        placed = placed.join(starts, ["__base", "__range"]).withColumn("__n", F.col("__at") - F.col("__from"))
        ranked = ranked.unionByName(placed.select(*based.columns, F.col("__n").cast("int").alias("__n")))
    new = F.when(F.col("__n") > 0, F.concat("__base", F.lit("."), F.col("__n").cast("string"))).otherwise(F.col("__base"))
    return ranked.withColumn(id_col, new).drop("__base", "__n")
