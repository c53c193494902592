"""Collapsing records that differ in their writing only.

Method: each record gets a canonical key.  Hot keys are detected exactly with partial counts per
input split; their rows go through a salted two-level aggregation, all others through one shuffle.
The representative of a group is its smallest identifier.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.hot import HOT_ROWS, HOT_SHARE, hot_keys, hot_limit
from strandlake.session import maybe_broadcast, stage

SALTS = 64


def canonical_text(text: Column, separators: str = ",;/|") -> Column:
    """``text`` without case, white space, punctuation, and the order and kind of its separators.

    Separators part it into members, of which empty ones are dropped and the others are sorted;
    letters and digits of any script are kept.  Null stays null; a text without any letter or digit
    becomes the empty string; members that repeat stay repeated.
    """
    listed = "".join(f"\\{c}" for c in separators)
    plain = F.regexp_replace(F.upper(text), rf"[^\p{{L}}\p{{N}}{listed}]++", "")
    members = F.filter(F.split(plain, f"[{listed}]"), lambda m: m != "")
    return F.when(plain.rlike(f"[{listed}]"), F.array_join(F.array_sort(members), ",")).otherwise(plain)


def _has_key(columns: Sequence[str]) -> str:
    return " and ".join(f"`{c}` is not null" for c in columns)


def _keyed(df: DataFrame, ident: str, exact: Sequence[str], written: Sequence[str]) -> DataFrame:
    """(id, k1, k2): a 128-bit key of the exact columns and the canonical texts; rows with a null have none."""
    parts = [F.col(f"`{c}`") for c in exact] + [canonical_text(F.col(f"`{c}`")) for c in written]
    return df.where(_has_key([ident, *exact, *written])).select(F.col(f"`{ident}`").alias("id"), F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(7919), *reversed(parts)).alias("k2"))


class CopyGroups:
    """The groups of copies in ``df``.

    Two rows are copies if they agree in the columns ``exact`` and, by :func:`canonical_text`, in
    ``written``.  ``ident`` is a unique long.  Keys are compared by 128 bits of two hashes of 64: that
    any two of n different keys agree has a chance of about n**2 / 2**129, 1e-15 for 10**12 keys.

    Defined cases: a row with a null identifier, exact or written column is no one's copy; texts
    that are empty after canonicalisation agree with each other; rows that agree as written are
    copies too; rows with the same identifier are one record; an empty table has no groups; further
    columns are not read.
    """

    def __init__(self, df: DataFrame, ident: str, exact: Sequence[str], written: Sequence[str], share: float = HOT_SHARE, least: int = HOT_ROWS):
        self._df, self._ident, self._columns = df, ident, [ident, *exact, *written]
        self._rows = stage(_keyed(df, ident, exact, written), "keyed")
        n = self._rows.count()
        hot = maybe_broadcast(stage(hot_keys(self._rows, n, hot_limit(n, share, least)), "hot").select("k1", "k2"))
        self._hot = self._rows.join(hot, ["k1", "k2"], "left_semi")
        self._cold = self._rows.join(hot, ["k1", "k2"], "left_anti")

    def _hot_groups(self) -> DataFrame:
        """(k1, k2, first_id, n) of the hot keys, in two levels: by salt, then by key."""
        salted = self._hot.groupBy("k1", "k2", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        return salted.groupBy("k1", "k2").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n"))

    def further_copies(self) -> DataFrame:
        """``first_id, id``: one row per copy that is not the first of its group."""
        in_hot = self._hot.join(maybe_broadcast(stage(self._hot_groups(), "hot_groups")), ["k1", "k2"]).select("first_id", "id")
        in_cold = self._cold.select(F.min("id").over(Window.partitionBy("k1", "k2")).alias("first_id"), "id")
        return in_hot.unionByName(in_cold).where("id > first_id")

    def representatives(self) -> DataFrame:
        """``first_id, n_copies``: every record once, with how often it was there.

        Records without a key (see above) stand for themselves, once each.
        """
        cold = self._cold.groupBy("k1", "k2").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        groups = self._hot_groups().unionByName(cold).select("first_id", F.col("n").alias("n_copies"))
        keyless = self._df.where(f"`{self._ident}` is not null and not ({_has_key(self._columns)})").select(F.col(f"`{self._ident}`").alias("first_id"))
        return groups.unionByName(keyless.withColumn("n_copies", F.lit(1).cast("long")))
