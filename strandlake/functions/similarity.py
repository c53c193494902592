"""Similarity of two sequences, as a batched function and as the column ``match_prop``."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.score import AffineScoreModel


#: Columns of which all are kept for the way back; longer targets keep every so-manieth and go over a stretch again.
_KEPT_COLUMNS = 1024


def _columns(matches: dict[str, int], n: int, state: tuple[int, int], target: str, free_start: bool) -> Iterator[tuple[int, int, int, int]]:
    """Per base of ``target``: where the diagonal step is free, where the column rises and falls, and its last step.

    Bit-parallel: a column of the edit table is two integers of ``n`` bits, its rises and its falls,
    so one base costs a dozen operations on machine words, whatever the query's length.
    """
    full, top = (1 << n) - 1, 1 << (n - 1)
    rise, fall = state
    lead = 0 if free_start else 1
    get = matches.get
    for base in target:
        same = get(base, 0)
        flat = (((same & rise) + rise) ^ rise | same | fall) & full
        over = fall | (full & ~(flat | rise))
        under = flat & rise
        last = 1 if over & top else -1 if under & top else 0
        over = over << 1 | lead
        rise = (under << 1 | ~(flat | over)) & full
        fall = over & flat & full
        yield flat, rise, fall, last


def _matches(query: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, base in enumerate(query):
        out[base] = out.get(base, 0) | 1 << i
    return out


def edit_distance(query: str, target: str, free_ends: bool = False) -> int:
    """Least edits between the texts or, with ``free_ends``, between ``query`` and any part of ``target``."""
    n = len(query)
    if not n:
        return 0 if free_ends else len(target)
    here = best = n
    for *_, last in _columns(_matches(query), n, ((1 << n) - 1, 0), target, free_ends):
        here += last
        best = min(best, here)
    return best if free_ends else here


def infix_operations(query: str, target: str) -> list[tuple[str, int]]:
    """Operations of a least-edit alignment of all of ``query`` inside ``target`` (free ends there).

    Of several, the one is taken that ends first and, read from its end, prefers aligned bases, then
    insertions, then deletions.  Memory is two bits a cell of the columns kept: all of a short
    target's, of a longer one's about twice the square root of their number.
    """
    n, m = len(query), len(target)
    if not n:
        return []
    if target.find(query) >= 0:
        return [("=", n)]
    matches, start = _matches(query), ((1 << n) - 1, 0)
    stretch = m if m <= _KEPT_COLUMNS else math.isqrt(m) + 1
    kept, states = [], [start]
    here, best, j = n, n, 0
    for c, (flat, rise, fall, last) in enumerate(_columns(matches, n, start, target, True), 1):
        here += last
        if here < best:
            best, j = here, c
        if stretch == m:
            kept.append((flat, rise))
        elif c % stretch == 0:
            states.append((rise, fall))
    i, ops, first = n, [], 0
    if stretch != m:
        first = m
    while i:
        if j <= first and j:  # the stretch before: its columns once more
            first = (j - 1) // stretch * stretch
            kept = [(flat, rise) for flat, rise, _, _ in _columns(matches, n, states[first // stretch], target[first:j], True)]
        if not j:
            ops.append(("I", i))
            break
        flat, rise = kept[j - 1 - first]
        if query[i - 1] == target[j - 1]:
            op = "="
        elif not flat >> (i - 1) & 1:
            op = "X"
        else:
            op = "I" if rise >> (i - 1) & 1 else "D"
        i, j = i - (op != "D"), j - (op != "I")
        if ops and ops[-1][0] == op:
            ops[-1] = (op, ops[-1][1] + 1)
        else:
            ops.append((op, 1))
    if len(ops) > 1 and ops[-1][0] == ops[-2][0]:
        last = ops.pop()
        ops[-1] = (last[0], ops[-1][1] + last[1])
    return ops[::-1]


def kmer_counts(seq: str, k: int) -> Counter:
    return Counter(seq[i : i + k] for i in range(len(seq) - k + 1))


def kmer_jaccard(a: str, b: str, k: int) -> float:
    """Shared k-mers over all k-mers, with multiplicity; 0 if one has none."""
    x, y = kmer_counts(a, k), kmer_counts(b, k)
    if not x or not y:
        return 0.0
    return sum((x & y).values()) / sum((x | y).values())


@dataclass(frozen=True)
class MatchScoreModel:
    """Alignment score of sequences up to ``map_limit`` bases, k-mer similarity beyond."""

    match: float = 2.0
    mismatch: float = 4.0
    affine_gap: tuple[tuple[float, float], ...] = ((4.0, 2.0), (24.0, 1.0))
    map_limit: int | None = 5000
    jaccard_kmer: int = 9
    rotate_min: int = 3

    def __post_init__(self) -> None:
        if self.map_limit is not None and self.map_limit < 0:
            raise ValueError("map_limit must not be negative")
        if self.jaccard_kmer <= 0 or self.rotate_min <= 0:
            raise ValueError("jaccard_kmer and rotate_min must be positive")

    @property
    def score_model(self) -> AffineScoreModel:
        return AffineScoreModel(self.match, self.mismatch, self.affine_gap)

    def score_align(self, a: str, b: str) -> float:
        model = self.score_model
        return sum(model.score(op, n) for op, n in infix_operations(a, b))

    def match_prop(self, a: str | None, b: str | None) -> float:
        """Similarity in [0, 1] of two sequences, case and outer blanks aside; 0 if one is missing.

        The shorter is aligned within the longer, doubled (so rotations match) unless it is very short.
        """
        a, b = (a or "").strip().upper(), (b or "").strip().upper()
        if not a or not b:
            return 0.0
        if len(a) > len(b):
            a, b = b, a
        if self.map_limit is None or len(b) <= self.map_limit:
            best = len(b) * abs(self.match)
            if a == b:
                return 1.0
            if len(a) >= self.rotate_min:
                score = min(self.score_align(a, b + b), len(a) * abs(self.match))
            else:
                score = self.score_align(a, b)
            return min(max(score / best, 0.0), 1.0)
        if len(a) > self.jaccard_kmer:
            return kmer_jaccard(a, b, self.jaccard_kmer)
        return float(a == b)

    def column(self, a: Column, b: Column) -> Column:
        """:meth:`match_prop` as FLOAT.  Missing and equal sequences are answered in the JVM; the rest
        goes to Python in Arrow batches, where each distinct pair of a batch is scored once."""
        model = self

        @F.pandas_udf("float")
        def scored(x: pd.Series, y: pd.Series) -> pd.Series:
            known: dict[tuple[str, str], float] = {}
            out = np.full(len(x), np.nan, np.float32)
            for i, pair in enumerate(zip(x, y, strict=True)):
                if pair[0] is not None and pair[1] is not None:
                    if pair not in known:
                        known[pair] = model.match_prop(*pair)
                    out[i] = known[pair]
            return pd.Series(out)

        clean = lambda s: F.upper(F.regexp_replace(s, r"\A\s+|\s+\z", ""))
        p, q = clean(a), clean(b)
        missing = F.coalesce(p == "", F.lit(True)) | F.coalesce(q == "", F.lit(True))
        hard = ~missing & (p != q)
        # a null argument keeps rows that need no scoring out of the Python work
        value = scored(F.when(hard, p), F.when(hard, q))
        return F.when(missing, F.lit(0.0).cast("float")).when(p == q, F.lit(1.0).cast("float")).otherwise(value)


def edit_distance_column(a: Column, b: Column, free_ends: bool = False) -> Column:
    """:func:`edit_distance` of two columns as INT; null if one is null."""

    @F.pandas_udf("int")
    def distances(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else edit_distance(p, q, free_ends) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return distances(a, b)


def has_sequence(seq: Column) -> Column:
    """Whether a sequence is neither null nor blank."""
    return F.coalesce(seq.rlike(r"\S"), F.lit(False))


def length_bound(a: Column, b: Column) -> Column:
    """The most that ``match_prop`` can be: smaller length over larger length."""
    x, y = (F.length(F.regexp_replace(s, r"\A\s+|\s+\z", "")) for s in (a, b))
    larger = F.greatest(x, y)
    return F.when(larger > 0, F.least(x, y) / F.when(larger > 0, larger)).otherwise(F.lit(0.0))
