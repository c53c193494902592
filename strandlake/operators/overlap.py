"""Multi-stage overlap joins of variants, with weighted choice of the best match of a pair.

A stage is a set of conditions; each compiles to join keys where it can (equal positions, equal
alleles) and else to range bins, and what remains is a residual predicate.  Stages are united, and
a pair found by several keeps its row of the largest weight; where all stages give a pair the same
row, no pairs are moved to be compared: stages that look for near positions under the same keys find
their pairs in one join, and other stages leave out the pairs of those before them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, fields, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import metrics
from strandlake.functions.segments import RUN, RUN_PARTS, run_overlap, segment_overlap, with_run_parts, with_runs
from strandlake.functions.similarity import MatchScoreModel, has_sequence, length_bound
from strandlake.operators.indexing import INDEX, with_index
from strandlake.operators.interval_join import range_candidates
from strandlake.operators.weights import DEFAULT_WEIGHTS, WeightStrategy
from strandlake.schema import check_columns, to_variant
from strandlake.session import maybe_broadcast, stage

JOIN_COLS = ("index_a", "index_b", "id_a", "id_b", "ro", "offset_dist", "offset_prop", "size_ro", "match_prop", "weight")
RESERVED = frozenset({INDEX, "_end_ro", RUN, *RUN_PARTS})
_SALTS = 16
_TASKS_A_CORE = 8
_MEASURES = frozenset({"ro", "offset_dist", "offset_prop", "size_ro", "match_prop", "seg_ro", "weight"})


@dataclass(frozen=True)
class Extra:
    """A user's predicate, filter or column: SQL text or a Column over ``_a`` and ``_b`` columns.

    ``requires`` names the input columns (without suffix) that it reads.
    """

    expr: str | Column
    alias: str | None = None
    requires: frozenset[str] = frozenset()

    def column(self) -> Column:
        c = F.expr(self.expr) if isinstance(self.expr, str) else self.expr
        return c.alias(self.alias) if self.alias else c


def _extra(x: Any) -> Extra:
    if isinstance(x, Extra):
        return x
    if isinstance(x, Mapping):
        return Extra(x["expr"], x.get("alias"), frozenset(x.get("requires", ())))
    if isinstance(x, (str, Column)):
        return Extra(x, x if isinstance(x, str) and x.isidentifier() else None)
    expr, alias, *requires = x
    return Extra(expr, alias, frozenset(requires[0] if requires else ()))


def _bounded(name: str, value: float | None, low: float, high: float | None, open_low: bool = False) -> None:
    if value is None:
        return
    if isinstance(value, bool) or not isinstance(value, (int, float)) or math.isnan(value) or value < low or (open_low and value == low) or (high is not None and value > high):
        raise ValueError(f"{name} = {value!r} is out of range")


@dataclass(frozen=True)
class OverlapStage:
    """Conditions on a pair; all that are given must hold.

    ``ro_min`` 0 asks for any overlap.  ``offset_max`` 0 asks for equal positions.
    ``match_filter_pass``: both have an empty filter list or both have not (``compat_filter_xor``
    asks for the opposite, as an earlier tool did).  ``match_prop_min`` 0 computes the similarity
    without asking for any.  ``join_predicates`` and ``join_filters`` are the user's own, applied
    before and after the measures.
    """

    ro_min: float | None = None
    size_ro_min: float | None = None
    offset_max: int | None = None
    offset_prop_max: float | None = None
    match_ref: bool = False
    match_alt: bool = False
    match_vartype: bool = False
    match_filter_pass: bool = False
    match_prop_min: float | None = None
    seg_ro_min: float | None = None
    join_predicates: tuple = ()
    join_filters: tuple = ()
    compat_filter_xor: bool = False

    def __post_init__(self) -> None:
        _bounded("ro_min", self.ro_min, 0, 1)
        _bounded("size_ro_min", self.size_ro_min, 0, 1, open_low=True)
        _bounded("offset_max", self.offset_max, 0, None)
        if self.offset_max is not None and int(self.offset_max) != self.offset_max:
            raise ValueError("offset_max must be whole")
        _bounded("offset_prop_max", self.offset_prop_max, 0, None)
        _bounded("match_prop_min", self.match_prop_min, 0, 1)
        _bounded("seg_ro_min", self.seg_ro_min, 0, 1)
        for name in ("join_predicates", "join_filters"):
            value = getattr(self, name)
            object.__setattr__(self, name, tuple(_extra(x) for x in ([value] if isinstance(value, (str, Column)) else value)))
        for name in ("match_ref", "match_alt", "match_vartype", "match_filter_pass"):
            object.__setattr__(self, name, bool(getattr(self, name)))

    @property
    def required(self) -> frozenset[str]:
        out = set()
        out |= {"ref"} if self.match_ref else set()
        out |= {"alt"} if self.match_alt else set()
        out |= {"vartype"} if self.match_vartype else set()
        out |= {"filter"} if self.match_filter_pass else set()
        out |= {"seq"} if self.match_prop_min is not None else set()
        out |= {"seg", "qry_pos", "qry_end"} if self.seg_ro_min is not None else set()
        for x in (*self.join_predicates, *self.join_filters):
            out |= x.requires
        return frozenset(out)

    def keys(self) -> list[str]:
        """Columns that must be equal."""
        out = ["chrom"]
        if self.offset_max == 0:
            out += ["pos", "end"]
        out += [c for c, on in (("ref", self.match_ref), ("alt", self.match_alt), ("vartype", self.match_vartype)) if on]
        if self.size_ro_min == 1 and self.offset_max != 0:
            out.append("varlen")
        return out

    def near(self) -> tuple | None:
        """What stages that look for their pairs in one range join must agree in; None if this one can not."""
        alone = self.match_prop_min is not None or self.seg_ro_min is not None or self.join_predicates or self.join_filters
        if alone or (self.ro_min is None and self.offset_max is None and self.offset_prop_max is None):
            return None
        return tuple(k for k in self.keys() if k not in ("pos", "end")), self.match_filter_pass, self.match_filter_pass and self.compat_filter_xor

    def reach(self) -> tuple[list[Column], list[Column], list[Column]]:
        """Ends of closed ranges that meet for all pairs of the stage: low and high of ``a``, high of ``b``, beside their starts."""
        pos = F.col("pos_a")
        if self.offset_max == 0:
            return [], [], []
        if self.offset_max is not None:
            return [pos - int(self.offset_max)], [pos + int(self.offset_max)], []
        if self.ro_min is not None:
            return [], [self._shared_end("a")], [self._shared_end("b")]
        reach = self._offset_reach()
        return [pos - reach], [pos + reach], []

    def _shared_end(self, side: str) -> Column:
        """What is shared reaches ``ro_min`` of both lengths, so the ranges meet even if each ends earlier by it."""
        return F.col(f"_end_ro_{side}") - F.floor(F.col(f"varlen_{side}") * F.lit(float(self.ro_min) * (1 - 1e-6)))

    def _offset_reach(self) -> Column:
        return F.ceil(F.col("varlen_a") * F.lit(float(self.offset_prop_max)) * F.lit(1 + 1e-6)) + 1

    def keyed(self, a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
        """Both sides with their key columns under common names, and these."""
        keys = self.keys()
        for k in keys:  # one key column of a common name; the suffixed ones stay
            a, b = a.withColumn(f"__k_{k}", F.col(f"{k}_a")), b.withColumn(f"__k_{k}", F.col(f"{k}_b"))
        on = [f"__k_{k}" for k in keys]
        if self.match_filter_pass:
            passed = F.size("filter_b") == 0
            a, b = a.withColumn("__k_pass", F.size("filter_a") == 0), b.withColumn("__k_pass", ~passed if self.compat_filter_xor else passed)
            on.append("__k_pass")
        return a, b, on

    def candidates(self, a: DataFrame, b: DataFrame, bin_width: int | None) -> DataFrame:
        """Pairs that may fulfil the stage, each once: by keys, and by the most selective range there is."""
        a, b, on = self.keyed(a, b)
        if self.size_ro_min is not None:
            a, b = a.where("varlen_a > 0"), b.where("varlen_b > 0")
        if self.match_prop_min:  # a missing sequence is like none
            a, b = a.where(has_sequence(F.col("seq_a"))), b.where(has_sequence(F.col("seq_b")))
        # reaches, as (low, high) of both sides
        if self.offset_max == 0:
            return a.join(b, on).drop(*on)
        if self.offset_max is not None:
            step = int(self.offset_max) + 1
            a = a.withColumn("__band", F.floor(F.col("pos_a") / F.lit(step)))
            b = b.withColumn("__band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col("pos_b") / F.lit(step)) + i)))
            return a.join(b, [*on, "__band"]).drop(*on, "__band")
        if self.ro_min is not None:
            a, b = a.withColumn("__high_a", self._shared_end("a")), b.withColumn("__high_b", self._shared_end("b"))
            low, high = ("pos_a", "pos_b"), ("__high_a", "__high_b")
        elif self.offset_prop_max is not None:
            reach = self._offset_reach()
            a = a.withColumn("__low", F.col("pos_a") - reach).withColumn("__high", F.col("pos_a") + reach)
            low, high = ("__low", "pos_b"), ("__high", "pos_b")
        elif self.size_ro_min is not None and self.size_ro_min < 1:
            bin_of = lambda s: F.floor(F.log(F.col(f"varlen_{s}").cast("double")) / F.lit(math.log(1 / self.size_ro_min) * (1 + 1e-9)))
            a = a.withColumn("__size", bin_of("a"))
            b = b.withColumn("__size", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: bin_of("b") + i)))
            return a.join(b, [*on, "__size"]).drop(*on, "__size")
        else:
            # all pairs of a chromosome (or key) are wanted, so a large one is salted
            a = a.withColumn("__salt", F.pmod(F.xxhash64("index_a"), F.lit(_SALTS)).cast("int"))
            b = b.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
            return a.join(b, [*on, "__salt"]).drop(*on, "__salt")
        return range_candidates(a, b, on, low, high, bin_width).drop(*on, "__low", "__high", "__high_a", "__high_b")

    def holds(self) -> list[Column]:
        """The exact conditions on a pair, but for those that need a measure computed late."""
        out = []
        if self.ro_min is not None:
            ro = F.col("ro")
            out.append(metrics.at_least(ro, self.ro_min) if self.ro_min > 0 else F.nanvl(ro, F.lit(0.0).cast("float")) > 0)
        if self.size_ro_min is not None:
            out.append(metrics.at_least(F.col("size_ro"), self.size_ro_min))
        if self.offset_max is not None and self.offset_max > 0:
            out.append(F.col("offset_dist") <= int(self.offset_max))
        if self.offset_prop_max is not None:
            out.append(metrics.at_most(F.col("offset_prop"), self.offset_prop_max))
        if self.match_prop_min:
            out.append(length_bound(F.col("seq_a"), F.col("seq_b")) >= F.lit(self.match_prop_min * (1 - 1e-6)))
        return out + [x.column() for x in self.join_predicates]

    def fulfilled(self) -> Column:
        """Whether a pair of one chromosome, found by any stage, fulfils this one; never null."""
        out = [F.col(f"{k}_a") == F.col(f"{k}_b") for k in self.keys() if k != "chrom"]
        if self.match_filter_pass:
            passed = F.size("filter_b") == 0
            out.append((F.size("filter_a") == 0) == (~passed if self.compat_filter_xor else passed))
        if self.match_prop_min:
            out += [has_sequence(F.col("seq_a")), has_sequence(F.col("seq_b"))]
        if self.offset_max:  # pairs of other stages may be too far apart for the INT of the measure
            out.append(metrics.offset() <= int(self.offset_max))
        return reduce(Column.__and__, (F.coalesce(c, F.lit(False)) for c in [*out, *self.holds(), *self.holds_late()]), F.lit(True))

    def fulfilled_near(self) -> Column:
        """Whether a candidate of :func:`_near_candidates` fulfils the stage; null is no. Short, as it is a join's condition."""
        out = []
        if self.offset_max == 0:
            out += [F.col("pos_a") == F.col("pos_b"), F.col("end_a") == F.col("end_b")]
        elif self.offset_max is not None:  # candidates may be too far apart for the INT of the measure
            out.append(metrics.offset() <= int(self.offset_max))
        return reduce(Column.__and__, [*out, *replace(self, offset_max=None).holds()])

    def holds_late(self) -> list[Column]:
        out = []
        if self.seg_ro_min is not None:
            out.append(metrics.at_least(F.col("seg_ro"), self.seg_ro_min))
        if self.match_prop_min:
            out.append(metrics.at_least(F.col("match_prop"), self.match_prop_min))
        return out + [x.column() for x in self.join_filters]


def _near_candidates(stages: Sequence[OverlapStage], a: DataFrame, b: DataFrame, bin_width: int | None) -> DataFrame:
    """Pairs that may fulfil one of ``stages``, which agree in :meth:`OverlapStage.near`, each once."""
    a, b, on = replace(stages[0], offset_max=None).keyed(a, b)  # without positions as keys
    low_a, high_a, high_b = ([c for s in stages for c in s.reach()[i]] for i in range(3))
    # starts are known, so least and greatest, which pass over nulls, are too
    at = lambda pick, start, ends: pick(F.col(start), *ends) if ends else F.col(start)
    a = a.withColumns({"__low": at(F.least, "pos_a", low_a), "__high_a": at(F.greatest, "pos_a", high_a)})
    b = b.withColumn("__high_b", at(F.greatest, "pos_b", high_b))
    # a task's time follows its pairs, not its bytes, so there are enough tasks for cores to end at about one time
    spark = a.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    met = range_candidates(a, b, on, ("__low", "pos_b"), ("__high_a", "__high_b"), bin_width, by_longer=True, parts=parts)
    return met.drop(*on, "__low", "__high_a", "__high_b")


def _stage(x: Any) -> OverlapStage:
    return x if isinstance(x, OverlapStage) else OverlapStage(**x)


@dataclass(frozen=True)
class PairwiseOverlap:
    """An overlap join of one or more stages; see :meth:`join`.

    ``join_cols`` are further columns of the result (names, SQL texts with alias, or
    :class:`Extra`); ``drop_default_join_cols`` leaves out the standard ones.  ``force_end_ro``
    measures overlap by end instead of pos + varlen.
    """

    stages: tuple = ()
    join_cols: tuple = ()
    drop_default_join_cols: bool = False
    match_score_model: MatchScoreModel = field(default_factory=MatchScoreModel)
    weight_strategy: WeightStrategy = DEFAULT_WEIGHTS
    force_end_ro: bool = False
    bin_width: int | None = None

    def __post_init__(self) -> None:
        stages = [self.stages] if isinstance(self.stages, (OverlapStage, Mapping)) else self.stages
        object.__setattr__(self, "stages", tuple(_stage(s) for s in stages))
        object.__setattr__(self, "join_cols", tuple(_extra(c) for c in self.join_cols))
        if not self.stages:
            raise ValueError("an overlap join needs a stage")
        if any(c.alias is None for c in self.join_cols):
            raise ValueError("a column of the result needs a name")
        if isinstance(self.weight_strategy, (list, tuple)):
            object.__setattr__(self, "weight_strategy", WeightStrategy(*self.weight_strategy))

    @classmethod
    def from_definition(cls, definition: Mapping | Iterable) -> PairwiseOverlap:
        """From a mapping of constructor arguments (``stages`` is needed) or a list of stages."""
        if not isinstance(definition, Mapping):
            return cls(tuple(definition))
        known = {f.name for f in fields(cls)}
        unknown = set(definition) - known
        if unknown or "stages" not in definition:
            raise ValueError(f"unknown keys {sorted(unknown)}" if unknown else "the key 'stages' is missing")
        return cls(**definition)

    @property
    def required_cols(self) -> frozenset[str]:
        """Columns that both tables must have."""
        out = {"chrom", "pos", "end"}
        for s in self.stages:
            out |= s.required
        for c in self.join_cols:
            out |= c.requires
        return frozenset(out - {"varlen", "id"})

    @property
    def _segments(self) -> bool:
        return any(s.seg_ro_min is not None for s in self.stages)

    def check_required_cols(self, df: DataFrame) -> frozenset[str]:
        """The required columns that ``df`` lacks."""
        return self.required_cols - set(df.columns)

    def check_reserved_cols(self, df: DataFrame) -> frozenset[str]:
        """The columns of ``df`` whose names are reserved."""
        return RESERVED & set(df.columns)

    def _prepared(self, df: DataFrame, suffix: str, retain_index: bool) -> DataFrame:
        check_columns(df, self.required_cols, f"table {suffix}")
        df = df.drop("_end_ro", RUN, *RUN_PARTS)
        extras = [x for s in self.stages for x in (*s.join_predicates, *s.join_filters)] + list(self.join_cols)
        if all(x.requires for x in extras):  # the table may be stored, so only what is read should be in it
            known = self.required_cols | {INDEX, "varlen", "id"}
            df = df.select(*[F.col(f"`{c}`") for c in df.columns if c in known])
        df = with_index(df, retain=retain_index)
        df = to_variant(df)
        if "varlen" not in df.columns:
            df = df.withColumn("varlen", F.col("end") - F.col("pos"))
        df = df.withColumn("varlen", F.abs("varlen"))
        if "id" not in df.columns:
            df = df.withColumn("id", F.lit(None).cast("string"))
        for c, on in (("ref", "match_ref"), ("alt", "match_alt")):
            if any(getattr(s, on) for s in self.stages):
                df = df.withColumn(c, F.upper(F.regexp_replace(c, r"\A\s+|\s+\z", "")))
        if self._segments:
            df = with_runs(df)
        end = F.col("end") if self.force_end_ro else F.col("pos") + F.col("varlen")
        df = df.withColumn("_end_ro", end).where("chrom is not null and pos is not null and `end` is not null")
        return df.select(*[F.col(f"`{c}`").alias("index_" + suffix if c == INDEX else f"{c}_{suffix}") for c in df.columns])

    def _rows_agree(self, sides: dict[str, DataFrame], named: set[str]) -> bool:
        """Whether a pair's row is the same from every stage, and no two pairs share their indexes.

        Only segments are measured in some stages and not in others.  ``named`` are the sides whose indexes
        the user gave; those may repeat.
        """
        if len({s.seg_ro_min is None for s in self.stages}) > 1:
            return False
        return all(sides[s].groupBy(f"index_{s}").count().where("count > 1").isEmpty() for s in sorted(named))

    def _parts(self) -> list[tuple[OverlapStage, ...]]:
        """The stages, those together that find their pairs in one join."""
        parts: dict[Any, tuple[OverlapStage, ...]] = {}
        for i, s in enumerate(self.stages):
            key = s.near() or i
            parts[key] = (*parts.get(key, ()), s)
        return list(parts.values())

    def _run_stage(self, part: Sequence[OverlapStage], a: DataFrame, b: DataFrame, with_match: bool, before: Sequence[OverlapStage] = (), runs: bool = False) -> DataFrame:
        """The pairs of a stage, or of several in one join, that none of the stages ``before`` finds; with ``runs`` all segments of a row are one run."""
        stage = part[0]
        pairs = stage.candidates(a, b, self.bin_width) if len(part) == 1 else _near_candidates(part, a, b, self.bin_width)
        pairs = pairs.withColumns({"ro": metrics.reciprocal_overlap(), "offset_dist": metrics.offset_distance(), "offset_prop": metrics.offset_proportion(), "size_ro": metrics.size_reciprocal()})
        late = [s for s in before if s.holds_late()]
        holds = stage.holds() if len(part) == 1 else [reduce(Column.__or__, (s.fulfilled_near() for s in part))]
        for c in [*holds, *(~s.fulfilled() for s in before if s not in late)]:
            pairs = pairs.where(c)
        if stage.seg_ro_min is not None:
            one = F.coalesce(F.greatest("_seg_n_a", "_seg_n_b"), F.lit(0)) < 2
            pairs = pairs.withColumn("seg_ro", run_overlap() if runs else F.when(one, run_overlap()).otherwise(segment_overlap()))
        match = self.match_score_model.column(F.col("seq_a"), F.col("seq_b")) if with_match else F.lit(None).cast("float")
        pairs = pairs.withColumn("match_prop", match)
        pairs = pairs.withColumn("weight", self.weight_strategy.expr(pairs.columns))
        for c in [*stage.holds_late(), *(~s.fulfilled() for s in late)]:
            pairs = pairs.where(c)
        out = [] if self.drop_default_join_cols else [F.col(c) for c in JOIN_COLS]
        out += [c.column() for c in self.join_cols]
        keys = [] if not self.drop_default_join_cols else [F.col(c).alias(f"__{c}") for c in ("index_a", "index_b", "weight")]
        return pairs.select(*out, *keys)

    def partners(self, df_a: DataFrame, df_b: DataFrame, retain_index: bool = False) -> DataFrame:
        """How many pairs :meth:`join` has for each row of ``df_a`` that is in one: ``index_a`` and ``n``.

        A single stage of keys alone asks for all pairs of a key, so the rows of ``df_b`` are counted by key and
        no pair is formed; all other stages form their pairs.
        """
        only = self.stages[0]
        if len(self.stages) > 1 or only.holds() or only.holds_late():
            return self.join(df_a, df_b, retain_index).groupBy("index_a").agg(F.count(F.lit(1)).alias("n"))
        a, b = self._prepared(df_a, "a", retain_index), self._prepared(df_b, "b", retain_index)
        a, b, on = only.keyed(a, b)
        # a few keys may have most of the rows, so their counts are broadcast where they are few
        counts = maybe_broadcast(b.groupBy(*on).agg(F.count(F.lit(1)).alias("n")))
        return a.select("index_a", *on).join(counts, on).groupBy("index_a").agg(F.sum("n").alias("n"))

    def join(self, df_a: DataFrame, df_b: DataFrame, retain_index: bool = False) -> DataFrame:
        """One row per pair that fulfils a stage.

        Columns: ``index_a, index_b, id_a, id_b, ro, offset_dist, offset_prop, size_ro, match_prop,
        weight`` (or those asked for).  Rows are named by their place in the table, or with
        ``retain_index`` by their ``_index``.  ``match_prop`` is null unless a stage asks for it.

        Defined cases: rows with a null chromosome or coordinate are in no pair; null alleles, types
        and filters match nothing; measures of a null length are null and fulfil no condition; if both lengths are 0 there is no reciprocal overlap; of several
        stages the row with the largest weight (null as the strategy's ``missing``) stays, then that
        of the earlier stage; repeated rows pair each on its own; empty tables give no rows; other
        columns are only read where a user's expression names them; user's expressions of several
        stages must be deterministic.
        """
        a, b = self._prepared(df_a, "a", retain_index), self._prepared(df_b, "b", retain_index)
        parts, each = self._parts(), [(s,) for s in self.stages]
        named = {s for s, df in (("a", df_a), ("b", df_b)) if retain_index and INDEX in df.columns}
        store = lambda: (stage(a, "side_a"), stage(b, "side_b"))
        if stored := len(parts) > 1 or self._segments:  # every join reads both sides; runs are formed once
            a, b = store()
        if self._segments:
            a, b = with_run_parts(a, "_a"), with_run_parts(b, "_b")
        # lists that are no runs need functions that the JVM does not compile, and with them the whole join
        runs = self._segments and a.where("_seg_n_a > 1").isEmpty() and b.where("_seg_n_b > 1").isEmpty()
        with_match = any(s.match_prop_min is not None for s in self.stages)
        apart = len(self.stages) > 1 and self._rows_agree({"a": a, "b": b}, named)
        if not apart:
            parts = each
            if len(parts) > 1 and not stored:
                a, b = store()
        found = [self._run_stage(p, a, b, with_match, [s for q in parts[:i] for s in q] if apart else (), runs) for i, p in enumerate(parts)]
        p = "__" if self.drop_default_join_cols else ""
        if apart:
            found = [reduce(DataFrame.unionByName, found)]
        if len(found) > 1:
            names = found[0].columns
            united = found[0].withColumn("__stage", F.lit(0))
            for i, f in enumerate(found[1:], 1):
                united = united.unionByName(f.withColumn("__stage", F.lit(-i)))
            rank = F.struct(F.coalesce(F.col(f"{p}weight"), F.lit(self.weight_strategy.missing).cast("float")), F.col("__stage"))
            best = united.groupBy(F.col(f"{p}index_a").alias("__ka"), F.col(f"{p}index_b").alias("__kb")).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in names]), rank).alias("__row"))
            found = [best.select("__row.*")]
        return found[0].drop("__index_a", "__index_b", "__weight") if p else found[0]

    def join_iter(self, df_a: DataFrame, df_b: DataFrame, retain_index: bool = False) -> Iterator[DataFrame]:
        """:meth:`join` as one frame per chromosome of ``df_a`` (at least one, maybe empty, frame)."""
        # joined and stored once; every frame is a part of it
        joined = replace(self, join_cols=(*self.join_cols, Extra("chrom_a", "__chrom", frozenset({"chrom"})))).join(df_a, df_b, retain_index)
        joined = stage(joined, "joined")
        names = sorted(r[0] for r in df_a.select("chrom").where("chrom is not null").distinct().toLocalIterator())
        for name in names or [None]:
            yield joined.where(F.col("__chrom") == F.lit(name)).drop("__chrom")
