"""Queries of the training-data operators: problems 4, 5, 6, 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.components import connected_groups
from strandlake.llm.copies import CopyGroups
from strandlake.llm.leaks import find_leaks
from strandlake.llm.pack import CAPACITY, pack, token_sizes
from strandlake.llm.split import SplitRule, split_oversized
from strandlake.llm.sql import SQL  # noqa: F401  (the driver reads it here)
from strandlake.llm.survivors import TruthDiscovery, entries_of, field_kinds, micros_of
from strandlake.session import stage


def _truth(spark: SparkSession, d: str) -> tuple[TruthDiscovery, DataFrame]:
    entries = entries_of(spark.read.parquet(f"{d}/merged_callset.parquet"), "mg_index", "mg_src", "src_name", "var_index")
    calls = spark.read.parquet(f"{d}/variant_calls.parquet").withColumnsRenamed({"src_name": "source", "var_index": "item"})
    trust = spark.read.parquet(f"{d}/callset_def.parquet").select(F.col("src_name").alias("source"), F.col("trust_rank").alias("rank"))
    fields = field_kinds(["id", "varlen", "ref", "alt", "filter", "seq"], calls)
    return TruthDiscovery(entries, calls, trust, fields, micros_of("called_at")), entries


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    decided = _truth(spark, d)[0].decided()
    return decided.select(F.col("group").alias("mg_index"), F.col("base.source").alias("src_name"), F.col("base.item").alias("var_index"))


def p4_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The best value of each field, and the share of the votes that it has."""
    truth, entries = _truth(spark, d)
    best = truth.survivors(entries).withColumnsRenamed({"group": "mg_index", "source": "src_name", "item": "var_index"})
    shares = {f"support_{f}": F.round(F.get("support", F.lit(i)), 6) for i, f in enumerate(("id", "varlen", "ref", "alt", "filter", "seq"))}
    return best.withColumns(shares).withColumn("filter", F.array_join("filter", ";", "null")).drop("support")


def p4_reliability(spark: SparkSession, d: str) -> DataFrame:
    """The reliability that every call set has in the end."""
    return _truth(spark, d)[0].reliabilities().select(F.col("source").alias("src_name"), F.round("weight", 6).alias("weight"), "converged")


def _copies(spark: SparkSession, d: str, **bounds) -> CopyGroups:
    calls = spark.read.parquet(f"{d}/variant_calls.parquet")
    return CopyGroups(calls, "call_id", ["src_name", "chrom", "pos", "end", "vartype"], ["ref", "alt"], **bounds)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d).further_copies().select(F.col("first_id").alias("first_call_id"), F.col("id").alias("call_id"))


def p5_representatives(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d).representatives().withColumnRenamed("first_id", "call_id")


def p5_salted(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p5_found with every group of three and more taken as a hot one."""
    return _copies(spark, d, share=0.0, least=3).further_copies().select(F.col("first_id").alias("first_call_id"), F.col("id").alias("call_id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return connected_groups(spark.read.parquet(f"{d}/join_row.parquet"), "index_a", "index_b").select(F.col("id").alias("call_id"), "group_id")


def p6_levels(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p6_found by tasks of few links, so that forests are merged in several levels."""
    return connected_groups(spark.read.parquet(f"{d}/join_row.parquet"), "index_a", "index_b", task_links=5000).select(F.col("id").alias("call_id"), "group_id")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = token_sizes(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")
    return pack(sizes).withColumnRenamed("id", "doc_id")


def p8_totals(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers, counted: documents, tokens lost, documents split for nothing, containers too full, places taken twice."""
    sizes = stage(token_sizes(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text"), "sizes")
    places = stage(pack(sizes), "places")
    per_doc = places.groupBy("id").agg(F.count(F.lit(1)).alias("parts"), F.sum("part_tokens").alias("placed"))
    docs = sizes.join(per_doc, "id", "left").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.col("n_tokens") - F.coalesce("placed", F.lit(-1))).alias("tokens_lost"),
        F.count_if((F.col("n_tokens") <= CAPACITY) & (F.col("parts") > 1)).alias("split_for_nothing"),
    )
    # the parts of a container are no more than its tokens
    after = F.lead("place_from").over(Window.partitionBy("container_id").orderBy("place_from"))
    taken = places.where("part_tokens > 0").withColumn("clash", after < F.col("place_from") + F.col("part_tokens"))
    per_container = taken.groupBy("container_id").agg(F.sum("part_tokens").alias("n"), F.count_if("clash").alias("clashes"))
    full = per_container.agg(F.count_if(F.col("n") > CAPACITY).alias("too_full"), F.coalesce(F.sum("clashes"), F.lit(0)).alias("places_taken_twice"))
    both = docs.unionByName(full, allowMissingColumns=True)  # one row each
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_item.parquet"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_pieces(spark, d).where("piece = 0").select("doc_id")


def p10_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Every document put together again from its pieces, with what is wrong with them: pieces above the limit or with another overlap."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    rule = SplitRule()
    pieces = stage(split_oversized(docs, "doc_id", "text", rule), "pieces")
    before = F.lag("byte_to").over(Window.partitionBy("id").orderBy("piece"))
    shared = F.lag("token_to").over(Window.partitionBy("id").orderBy("piece")) - F.col("token_from")
    sized = pieces.withColumns({"from": F.coalesce(before, F.lit(0)), "shared": shared}).withColumn("own", F.monotonically_increasing_id())
    sizes = token_sizes(sized, "own", "piece_text").withColumnsRenamed({"id": "own", "n_tokens": "own_tokens"})
    sized = sized.join(sizes, "own").withColumn("new", F.expr("substring(cast(piece_text as binary), cast(`from` - byte_from + 1 as int), cast(byte_to - `from` as int))"))
    rebuilt = sized.groupBy(F.col("id").alias("doc_id")).agg(
        F.array_sort(F.collect_list(F.struct("piece", "new"))).alias("parts"),  # no more than the document itself
        F.count_if((F.col("own_tokens") > rule.limit) | (F.col("token_to") - F.col("token_from") > rule.limit)).alias("too_large"),
        F.count_if(~F.col("shared").between(rule.overlap, rule.overlap + 3)).alias("wrong_overlap"),
    )
    whole = F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.new))")
    rebuilt = rebuilt.select("doc_id", F.octet_length(whole).alias("n"), F.md5(whole).alias("md5"), "too_large", "wrong_overlap")
    text = F.col("text").cast("binary")
    out = docs.join(rebuilt, "doc_id", "left").select("doc_id", F.coalesce("n", F.octet_length(text)).alias("n_bytes"), F.coalesce("md5", F.md5(text)).alias("md5"), F.coalesce("too_large", F.lit(0)).alias("too_large"), F.coalesce("wrong_overlap", F.lit(0)).alias("wrong_overlap"))
    return out.withColumn("n_bytes", F.col("n_bytes").cast("long"))


QUERIES = {f.__name__: f for f in (p4_found, p4_survivors, p4_reliability, p5_found, p5_representatives, p5_salted, p6_found, p6_levels, p8_containers, p8_totals, p9_found, p10_found, p10_pieces, p10_rebuilt)}
