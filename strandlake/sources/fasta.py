"""FASTA indexes and FASTA files as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.indexing import with_index

# The columns of an index.
FAI_COLUMNS = ("chrom", "len", "pos", "line_bp", "line_bytes")


def read_fai(spark: SparkSession, path: str, cols: Sequence[str] | None = ("chrom", "len"), name: str | None = None) -> DataFrame:
    """The columns ``cols`` (None: all) of a FASTA index; ``name`` renames the column ``chrom``."""
    wanted = list(FAI_COLUMNS if cols is None else cols)
    unknown = set(wanted) - set(FAI_COLUMNS)
    if unknown:
        raise ValueError(f"a FASTA index has no columns {sorted(unknown)}")
    schema = ", ".join(f"{c} {'string' if c == 'chrom' else 'long'}" for c in FAI_COLUMNS)
    df = spark.read.csv(path, sep="\t", schema=schema, quote="").select(*wanted)
    return df.withColumnRenamed("chrom", name) if name and "chrom" in wanted else df


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, order, seq``: one row per record of a FASTA file (plain or ``.gz``), in file order.

    The name is the header up to the first white space; line ends are taken out of the sequence.
    """
    # records are parted where a line begins with '>', so one within a header line parts nothing;
    # only the first record of a file still has its own '>' then
    raw = F.regexp_replace("value", r"\A\s*>|\r", "")
    rows = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "").select(raw.alias("value"))
    head = F.regexp_extract("value", r"\A([^\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"\A[^\n]*", ""), r"\s+", "")
    named = rows.select(F.regexp_extract(head, r"\A\s*(\S*)", 1).alias("chrom"), seq.alias("seq"))
    return with_index(named, name="order", store=False).select("chrom", F.col("order").cast("int").alias("order"), "seq")


def fa_info(spark: SparkSession, path: str, fai: str | None = None) -> DataFrame:
    """The index of a FASTA file with ``md5`` of each upper-cased sequence and its ``order`` in the file."""
    index = read_fai(spark, fai or f"{path}.fai", None)
    sums = read_fasta(spark, path).select("chrom", F.md5(F.upper("seq")).alias("md5"), "order")
    return index.join(sums, "chrom", "left")
