"""The tables behind a dot plot: k-mer matches of two sequences, and the lines they form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.kmer import canonical, explode_kmers, reverse_complement


def match_points(df: DataFrame, seq_x: str, seq_y: str, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, ``x, y, strand``: every shared k-mer of the two sequences of a row, forward and reverse."""
    keep = [F.col(c) for c in keys]
    x = explode_kmers(df.select(*keep, F.col(seq_x).alias("__s")), "__s", k, place="x").withColumn("__c", canonical(F.col("kmer")))
    y = explode_kmers(df.select(*keep, F.col(seq_y).alias("__s")), "__s", k, place="y").withColumn("__c", canonical(F.col("kmer")))
    met = x.withColumnRenamed("kmer", "kx").join(y.withColumnRenamed("kmer", "ky"), [*keys, "__c"])
    strands = F.array_compact(F.array(F.when(F.col("kx") == F.col("ky"), F.lit("+")), F.when(F.col("kx") == reverse_complement(F.col("ky")), F.lit("-"))))
    return met.select(*keys, "x", "y", F.explode(strands).alias("strand"))


def match_lines(points: DataFrame, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Points that follow each other on a diagonal, as one line: ``strand, x_pos, x_end, y_pos, y_end, n_points``."""
    diagonal = F.when(F.col("strand") == "+", F.col("x") - F.col("y")).otherwise(F.col("x") + F.col("y"))
    on = Window.partitionBy(*keys, "strand", "__d").orderBy("x")
    run = points.withColumn("__d", diagonal).withColumn("__run", F.col("x") - F.row_number().over(on))
    return run.groupBy(*keys, "strand", "__d", "__run").agg(F.min("x").alias("x_pos"), (F.max("x") + k).alias("x_end"), F.min("y").alias("y_pos"), (F.max("y") + k).alias("y_end"), F.count(F.lit(1)).alias("n_points")).drop("__d", "__run")
