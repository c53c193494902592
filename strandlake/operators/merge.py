"""Merging many call sets into one, record by record, with the provenance of every record.

The merge is cumulative: each call set is matched against what was merged before, matches join
the group of their partner, and all other records found groups.  Only the loop over call sets is on
the driver; every step is a set of joins, cut off from its history by a stored table.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from enum import Enum
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions.variants import default_id, version_ids
from strandlake.operators.indexing import INDEX, numbered, with_index
from strandlake.operators.overlap import Extra, PairwiseOverlap
from strandlake.schema import VARIANT, check_columns
from strandlake.session import BROADCAST_ROWS, new_path, stage

#: Stored tables of groups that are read side by side before they are made one.
COMPACT = 32
_STATS = ("ro", "offset_dist", "offset_prop", "size_ro", "match_prop", "weight")


class LeadStrategy(Enum):
    """Whose values a group takes: its leftmost entry, or its earliest source."""

    LEFT = "left"
    FIRST = "first"


@dataclass(frozen=True)
class CallsetDef:
    """A call set: a table, a name (``source_<n>`` by default) and metadata (text, or a dict kept as JSON)."""

    table: DataFrame
    name: str | None = None
    meta: Any = None

    @classmethod
    def of(cls, x: Any) -> CallsetDef:
        if isinstance(x, cls):
            return x
        if isinstance(x, DataFrame):
            return cls(x)
        parts = tuple(x)
        if not 1 <= len(parts) <= 3:
            raise ValueError(f"a call set has one to three parts, not {len(parts)}")
        if not isinstance(parts[0], DataFrame):
            raise TypeError("the first part of a call set is its table")
        return cls(*parts)

    def meta_text(self) -> str | None:
        if self.meta is None or isinstance(self.meta, str):
            return self.meta
        return json.dumps(self.meta)


def normalize_callsets(callsets: Iterable[Any]) -> list[CallsetDef]:
    """Names are filled in and made different by ``.1``, ``.2``, ..."""
    out: list[CallsetDef] = []
    for i, c in enumerate(map(CallsetDef.of, callsets), 1):
        base = str(c.name).strip() if c.name is not None else ""
        base = base or f"source_{i}"
        name, n = base, 0
        while name in {o.name for o in out}:
            n += 1
            name = f"{base}.{n}"
        out.append(CallsetDef(c.table, name, c.meta_text()))
    return out


def one_to_one(matches: DataFrame) -> DataFrame:
    """The best partner of each ``index_a``, then the best of those of each ``index_b``.

    Best is the largest weight (null last), then the smallest index.  A record whose best partner
    goes to a better rival has none; it does not fall back to its second choice.
    """
    by = F.col("weight").desc_nulls_last()
    first = matches.withColumn("__n", F.row_number().over(Window.partitionBy("index_a").orderBy(by, "index_b"))).where("__n = 1")
    return first.withColumn("__n", F.row_number().over(Window.partitionBy("index_b").orderBy(by, "index_a"))).where("__n = 1").drop("__n")


@dataclass(frozen=True)
class MergeCumulative:
    """The merge; call it with the call sets, in the order in which they are to be merged.

    The result has all columns of the call sets (but those that begin with ``_``) in the order they
    are first seen, then ``mg_src`` (the entries of the group), ``mg_stat`` (how each entry but the
    founder matched) and ``mg_src_lead`` (the entry whose values the row has).

    A group is represented by its founder in later matches.  ``varlen`` takes part in matching where
    a call set has it.  Defined cases: null ids become ``var<index>``; rows with a null coordinate
    match nothing and found groups; columns that a lead's call set lacks are null (``filter``:
    empty); an empty call set adds nothing; without any call set there is no merge (ValueError).
    """

    pairwise_join: PairwiseOverlap
    lead_strategy: LeadStrategy | str = LeadStrategy.LEFT

    def __post_init__(self) -> None:
        if isinstance(self.lead_strategy, str):
            object.__setattr__(self, "lead_strategy", LeadStrategy(self.lead_strategy.lower()))

    def __call__(self, callsets: Iterable[Any], retain_index: bool = False, pre_filter: str | Column | Sequence[str | Column] | None = None, sort: bool = True, add_id: bool = True) -> DataFrame:
        sets = normalize_callsets(callsets)
        if not sets:
            raise ValueError("there is no call set to merge")
        filters = [] if pre_filter is None else [pre_filter] if isinstance(pre_filter, (str, Column)) else list(pre_filter)
        needed = self.pairwise_join.required_cols | {"chrom", "pos", "end"}
        types: dict[str, T.DataType] = {"_src_index": T.LongType()}
        spark = sets[0].table.sparkSession
        path, tables = new_path(spark, "callsets"), []
        for k, c in enumerate(sets):
            check_columns(c.table, needed, f"call set {c.name}")
            t = with_index(c.table, name=INDEX, retain=retain_index).withColumnRenamed(INDEX, "_src_index")
            t = t.withColumn("id", default_id("_src_index") if "id" in t.columns else F.concat(F.lit("var"), F.col("_src_index").cast("string")))
            for f in filters:
                t = t.where(f)
            kept = [f for f in t.schema.fields if not f.name.startswith("_") or f.name == "_src_index" or f.name in needed]
            for f in kept:
                types.setdefault(f.name, f.dataType)
            t = t.select(*[F.col(f"`{f.name}`").cast(types[f.name]).alias(f.name) for f in kept])
            t.write.parquet(f"{path}/_k={k}")
            tables.append(spark.read.schema(t.schema).parquet(f"{path}/_k={k}"))
        order = [c for c in types if not c.startswith("_")]
        sources = self._merge(tables, sorted((needed | {"id", "varlen"}) - {INDEX}))
        # a call set's missing columns are null in the one table of all of them
        everything = spark.read.schema(T.StructType([*[T.StructField(c, t) for c, t in types.items()], T.StructField("_k", T.IntegerType())])).parquet(path)
        return self._finish(sets, everything, sources, order, types, sort, add_id)

    def _founder_columns(self, t: DataFrame, columns: Sequence[str]) -> list[Column]:
        return [F.col(f"`{c}`") if c in t.columns else (F.col("end") - F.col("pos")).alias("varlen") for c in columns]

    def _merge(self, tables: list[DataFrame], columns: list[str]) -> DataFrame:
        """One row per entry of a group: ``_mg``, where the entry comes from, and how it matched the founder."""
        founders: list[DataFrame] = []
        sources: list[DataFrame] = []
        n_groups = 0
        none = [F.lit(None).cast(t).alias(s) for s, t in zip(_STATS, ("float", "int", "float", "float", "float", "float"), strict=True)]
        join = self.pairwise_join
        join = replace(join, join_cols=(*join.join_cols, Extra("pos_b", "_pos_b", frozenset({"pos"}))), drop_default_join_cols=False)
        for k, t in enumerate(tables):
            fresh = t
            if founders:
                known = reduce(DataFrame.unionByName, founders)
                met = join.join(known.withColumnRenamed("_mg", INDEX), t.withColumnRenamed("_src_index", INDEX), retain_index=True)
                best = stage(one_to_one(met.select("index_a", "index_b", "id_b", "_pos_b", *_STATS)), "matches")
                sources.append(best.select(F.col("index_a").alias("_mg"), F.lit(k).alias("src_index"), F.col("index_b").alias("var_index"), F.col("id_b").alias("var_id"), F.col("_pos_b").alias("_pos"), F.lit(False).alias("_founder"), *_STATS))
                fresh = t.join(best.select(F.col("index_b").alias("_src_index")), "_src_index", "left_anti")
            # new groups are numbered in the order of their coordinates, so numbers are reproducible;
            # the index is a stored table, so the history of a step ends here
            fresh, n = numbered(fresh.select("_src_index", *self._founder_columns(fresh, columns)), ["chrom", "pos", "end", "id", "_src_index"], "_nth")
            fresh = fresh.withColumn("_mg", F.col("_nth") + n_groups)
            n_groups += n
            sources.append(fresh.select("_mg", F.lit(k).alias("src_index"), F.col("_src_index").alias("var_index"), F.col("id").alias("var_id"), F.col("pos").alias("_pos"), F.lit(True).alias("_founder"), *none))
            founders.append(fresh.select("_mg", *[F.col(f"`{c}`") for c in columns]))
            if len(founders) >= COMPACT:  # plans of very many call sets stay short
                founders, sources = ([stage(reduce(DataFrame.unionByName, x), "compact")] for x in (founders, sources))
        return reduce(DataFrame.unionByName, sources)

    def _finish(self, sets: list[CallsetDef], everything: DataFrame, sources: DataFrame, order: list[str], types: dict[str, T.DataType], sort: bool, add_id: bool) -> DataFrame:
        told = everything.sparkSession.createDataFrame([(i, c.name, c.meta) for i, c in enumerate(sets)], "src_index int, src_name string, src_meta string")
        sources = sources.join(F.broadcast(told) if len(sets) <= BROADCAST_ROWS else told, "src_index")
        src = F.struct("src_index", "src_name", "src_meta", "var_index", "var_id")
        stat = F.when(F.col("_founder"), F.lit(None)).otherwise(F.struct(*_STATS))
        # a group has one entry per call set at most, so its list is bounded by their number
        listed = sources.groupBy("_mg").agg(F.array_sort(F.collect_list(F.struct(F.col("src_index").alias("o"), F.col("_pos").alias("p"), src.alias("src"), stat.alias("stat")))).alias("x"))
        places = F.transform("x", lambda e: e["p"])
        lead = F.greatest(F.array_position(places, F.array_min(places)) - 1, F.lit(0)) if self.lead_strategy is LeadStrategy.LEFT else F.lit(0)
        groups = listed.select(
            "_mg",
            F.transform("x", lambda e: e["src"]).alias("mg_src"),
            F.filter(F.transform("x", lambda e: e["stat"]), lambda s: s.isNotNull()).alias("mg_stat"),
            F.coalesce(lead, F.lit(0)).cast("long").alias("mg_src_lead"),
        )
        of_lead = F.get("mg_src", F.col("mg_src_lead").cast("int"))
        leads = groups.withColumn("_k", of_lead["src_index"]).withColumn("_src_index", of_lead["var_index"])
        merged = everything.select("_k", "_src_index", *[F.col(f"`{c}`") for c in order]).join(leads, ["_k", "_src_index"]).drop("_k", "_src_index")
        filters = types.get("filter", T.ArrayType(T.StringType()))
        merged = merged.withColumn("filter", F.coalesce("filter" if "filter" in order else F.lit(None), F.array().cast(filters)))
        if add_id:
            merged = version_ids(merged, tie=["chrom", "pos", "end", "_mg"], ids=everything)
        if sort:
            merged = merged.orderBy("chrom", "pos", "end", "id")
        return merged.select(*[F.col(f"`{c}`") for c in order], "mg_src", "mg_stat", "mg_src_lead")


def variant_columns(df: DataFrame) -> list[str]:
    """The columns of ``df`` that the variant schema knows."""
    return [f.name for f in VARIANT.fields if f.name in df.columns]
