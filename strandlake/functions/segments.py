"""Reciprocal overlap of aligned segments, computed inside each row of a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that :func:`with_runs` and :func:`with_run_parts` add.
RUN, RUN_PARTS = "_seg_run", ("_seg_n", "_seg_pos", "_seg_end", "_seg_scale", "_seg_span", "_seg_loose")


def _length(s: Column, what: str) -> Column:
    return F.abs(s[f"{what}end"] - s[f"{what}pos"]).cast("double")


def with_runs(df: DataFrame) -> DataFrame:
    """``df`` with the segments of each row as one run, where they are: each begins where the one before ends, at the same scale.

    In a pair such a list counts as its run would; segments without reference bases add nothing there.  ``_seg_run`` has their kind ``n`` (0: an empty list, 1: a run,
    2: none; null: a null list), the ends ``p`` and ``e``, the query bases ``q`` and those of all segments, ``own``.
    """
    of = {f.name: f.dataType.simpleString() for f in df.schema["seg"].dataType.elementType.fields}
    kind = f"struct<n:int,p:{of['pos']},e:{of['end']},q:double>"

    def run(n: int, p: Column, e: Column, q: Column) -> Column:
        return F.struct(F.lit(n).alias("n"), p.alias("p"), e.alias("e"), q.alias("q")).cast(kind)

    def add(r: Column, x: Column) -> Column:
        q = _length(x, "qry_")
        goes_on = (r["n"] == 1) & (r["e"] == x["pos"]) & (r["p"] < r["e"]) & (x["pos"] < x["end"]) & (r["q"] * (x["end"] - x["pos"]) == q * (r["e"] - r["p"]))
        none = F.lit(None)
        return F.when(x["pos"] == x["end"], r).when(r["n"] == 0, run(1, x["pos"], x["end"], q)).when(goes_on, run(1, r["p"], x["end"], r["q"] + q)).otherwise(run(2, none, none, none))

    none = F.lit(None)
    own = F.aggregate("seg", F.lit(0.0), lambda acc, x: acc + _length(x, "qry_"))
    found = F.aggregate("seg", run(0, none, none, none), add)
    return df.withColumn(RUN, F.struct(found.alias("run"), own.alias("own")))


def with_run_parts(df: DataFrame, suffix: str) -> DataFrame:
    """What a pair needs of a stored ``_seg_run``, as columns of their own."""
    run, own = F.col(f"{RUN}{suffix}.run"), F.col(f"{RUN}{suffix}.own")
    parts = (run["n"], run["p"], run["e"], F.try_divide(run["q"], F.abs(run["e"] - run["p"]).cast("double")), _span(suffix), _span(suffix) - own)
    return df.withColumns({f"{name}{suffix}": part for name, part in zip(RUN_PARTS, parts, strict=True)}).drop(f"{RUN}{suffix}")


def _span(s: str) -> Column:
    return F.abs(F.col(f"qry_end{s}") - F.col(f"qry_pos{s}")).cast("double")


def run_overlap(a: str = "_a", b: str = "_b") -> Column:
    """:func:`segment_overlap` of lists that are one run each or empty, from the columns of :func:`with_run_parts`.

    Kept small, so that the JVM compiles the join it is a condition of; ``least`` and ``greatest`` pass over nulls.
    """
    n, pos, end, scale, span, loose = ({s: F.col(f"{c}{s}") for s in (a, b)} for c in RUN_PARTS)
    shared = F.least(end[a], end[b]) - F.greatest(pos[a], pos[b])
    aligned = F.when(n[b] == 1, F.greatest(shared * scale[a], F.lit(0.0))).otherwise(F.lit(0.0))
    larger = F.greatest(span[a], span[b])
    value = F.try_divide(F.greatest(F.least(aligned + F.least(loose[a], loose[b]), larger), F.lit(0.0)), larger)
    return F.when(n[a].isNull() | n[b].isNull(), F.lit(1.0)).otherwise(value).cast("float")


def segment_overlap(a: str = "_a", b: str = "_b") -> Column:
    """Overlap of the segment lists ``seg_a`` and ``seg_b`` in query bases over the larger query span, in [0, 1].

    Each pair of segments gives its overlap on the reference, scaled from the reference length to
    the query length of the segment of ``a``; all pairs are added.  Query bases in no segment are added as far as both
    sides have them.  A segment is a struct (pos, end, qry_pos, qry_end).  A null list says nothing of
    segments: the value is 1; an empty list has no aligned bases; a pair without query span is null.
    """
    sa, sb = F.col(f"seg{a}"), F.col(f"seg{b}")

    def total(pairs: Column, f) -> Column:
        return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + f(x))

    def pair(x: Column, y: Column) -> Column:
        shared = (F.least(x["end"], y["end"]) - F.greatest(x["pos"], y["pos"])).cast("double")
        ref = _length(x, "")
        return F.greatest(F.coalesce(F.when(ref != 0, shared / F.when(ref != 0, ref)) * _length(x, "qry_"), F.lit(0.0)), F.lit(0.0))

    aligned = total(sa, lambda x: total(sb, lambda y: pair(x, y)))
    loose = F.least(*[_span(s) - total(F.col(f"seg{s}"), lambda x: _length(x, "qry_")) for s in (a, b)])
    larger = F.greatest(_span(a), _span(b))
    value = F.when(larger != 0, (aligned + loose) / F.when(larger != 0, larger))
    return F.when(sa.isNull() | sb.isNull(), F.lit(1.0)).when(larger != 0, F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0))).cast("float")
