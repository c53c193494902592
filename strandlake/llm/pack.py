"""Filling containers of fixed capacity with items of varying length.

Method: non-negative least squares.  The histogram of lengths has at most ``capacity`` bins whatever
the number of items, so the plan is made on it: all combinations of up to three lengths that fill a
container exactly are enumerated, their repeat counts are the non-negative least-squares fit to the
histogram, rounded; what is left over is packed greedily (largest first, best fit), again on the
histogram.  Items then take the places of the plan by their rank among items of their length, which
is found by partial counts, never by gathering the items of one length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.tokens import VOCABULARY, tokenizer
from strandlake.session import stage

CAPACITY = 2048


def exact_combinations(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All multisets of one to three ``lengths`` with sum ``capacity``; rows, filled up with zeros."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    rows = [np.array([[capacity, 0, 0]])] if have[capacity] else []
    a = lengths[lengths <= capacity // 2]
    a = a[have[capacity - a]]
    rows.append(np.stack([a, capacity - a, 0 * a], axis=1))
    for x in lengths[lengths * 3 <= capacity]:
        y = lengths[(lengths >= x) & (2 * lengths <= capacity - x)]
        y = y[have[capacity - x - y]]
        rows.append(np.stack([np.full_like(y, x), y, capacity - x - y], axis=1))
    return np.concatenate(rows).astype(np.int64)


def nnls(parts: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that makes the lengths used by ``parts`` (x times each) close to ``counts``.

    Accelerated projected gradient; the matrix is never built: column j has its (up to) three
    lengths, row 0 (no length) does not count.
    """
    if not len(parts):
        return np.zeros(0)
    size = len(counts)
    times = lambda x: np.bincount(parts.ravel(), np.repeat(x, parts.shape[1]), minlength=size) * (np.arange(size) > 0)
    back = lambda r: r[parts].sum(axis=1)
    v = np.ones(len(parts))
    for _ in range(30):  # the largest eigenvalue, for the step
        w = back(times(v))
        v = w / np.linalg.norm(w)
    step = 1 / (1.05 * float(v @ back(times(v))))
    target = counts.astype(float) * (np.arange(size) > 0)
    x, y, t = np.zeros(len(parts)), np.zeros(len(parts)), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(times(y) - target))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan_containers(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a container, how many such containers); uses each length exactly ``counts`` times."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    lengths = np.flatnonzero(left)
    plan: list[tuple[tuple[int, ...], int]] = []
    if len(lengths):
        parts = exact_combinations(lengths, capacity)
        x = nnls(parts, left)
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 0.5:
                break
            combo = parts[j][parts[j] > 0]
            own, m = np.unique(combo, return_counts=True)
            n = int(min(round(x[j]), (left[own] // m).min()))
            if n > 0:
                left[own] -= n * m
                plan.append((tuple(combo.tolist()), n))
    while left.any():
        combo, room, free = [], capacity, left.copy()
        while room > 0:
            fits = np.flatnonzero(free[: room + 1])
            if not len(fits):
                break
            best = int(fits[-1])
            k = int(min(free[best], room // best))
            combo += [best] * k
            free[best] -= k
            room -= k * best
        own, m = np.unique(combo, return_counts=True)
        n = int((left[own] // m).min())
        left[own] -= n * m
        plan.append((tuple(combo), n))
    return plan


@dataclass
class _Places:
    """Where the items of each length go: runs of ranks, sorted by (length, first rank)."""

    key: np.ndarray
    length: np.ndarray
    first_rank: np.ndarray
    per_container: np.ndarray
    container: np.ndarray
    offset: np.ndarray

    SHIFT = 44

    @classmethod
    def of(cls, plan: list[tuple[tuple[int, ...], int]]) -> _Places:
        rows, next_rank, container = [], {}, 0
        for combo, n in plan:
            offset = 0
            for length in sorted(set(combo), reverse=True):
                m = combo.count(length)
                rank = next_rank.get(length, 0)
                rows.append(((length << cls.SHIFT) + rank, length, rank, m, container, offset))
                next_rank[length] = rank + n * m
                offset += m * length
            container += n
        columns = np.array(sorted(rows), np.int64).reshape(-1, 6).T
        return cls(*columns)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << self.SHIFT) + rank, "right") - 1
        nth = rank - self.first_rank[at]
        m = self.per_container[at]
        return self.container[at] + nth // m, self.offset[at] + nth % m * length


def token_sizes(df: DataFrame, ident: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``id, n_tokens`` of every row; a null text has 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        for batch in batches:
            sizes = [tok.count(t.as_py().encode("utf-8", "replace").decode()) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["id", "n_tokens"])

    return df.select(F.col(f"`{ident}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t")).mapInArrow(run, "id long, n_tokens long")


def pack(sizes: DataFrame, capacity: int = CAPACITY, ident: str = "id", size: str = "n_tokens", *, bucket_rows: int = 100_000) -> DataFrame:
    """``id, part, container_id, token_from, part_tokens, place_from``: each item's place, one row per part.

    An item is split only if it exceeds ``capacity``: then into full parts and a rest.  ``token_from``
    is where the part begins in its item, ``place_from`` where it stands in its container; the parts
    of a container never overlap nor exceed it.  The same sizes give the same places.

    Defined cases: an item of size 0 or null takes no room and stands at the start of container 0; a
    null id is an id like others; repeated rows are items of their own; an empty table gives no rows;
    further columns are not read.  Negative sizes are refused.
    """
    items = sizes.select(F.col(f"`{ident}`").cast("long").alias("id"), F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)).alias("n"))
    n_parts = F.greatest(F.ceil(F.col("n") / F.lit(capacity)), F.lit(1))
    parts = items.select("id", "n", F.explode(F.sequence(F.lit(0).cast("long"), n_parts.cast("long") - 1)).alias("part"))
    parts = parts.select("id", "part", (F.col("part") * capacity).alias("token_from"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("part") * capacity).alias("len"))
    parts = stage(parts, "parts")
    counts = np.zeros(capacity + 1, np.int64)
    # no more than capacity + 1 lengths, however many items
    for r in parts.groupBy("len").count().collect():
        if r.len < 0:
            raise ValueError("a size is negative")
        counts[r.len] = r["count"]
    places = _Places.of(plan_containers(counts, capacity))

    # rank within the length: rank within a bucket plus the counts of the buckets before it
    n_buckets = max(1, int(counts.sum()) // bucket_rows + 1)
    bucketed = parts.withColumn("bucket", F.pmod(F.xxhash64("id", "part"), F.lit(n_buckets)))
    before = bucketed.groupBy("len", "bucket").count()
    before = before.select("len", "bucket", (F.sum("count").over(Window.partitionBy("len").orderBy("bucket")) - F.col("count")).alias("before"))
    ranked = bucketed.withColumn("rn", F.row_number().over(Window.partitionBy("len", "bucket").orderBy("id", "part"))).join(before, ["len", "bucket"])
    ranked = ranked.select("id", "part", "token_from", "len", (F.col("before") + F.col("rn") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            container, offset = np.zeros_like(length), np.zeros_like(length)
            full = length > 0
            if full.any():
                container[full], offset[full] = places.place(length[full], rank[full])
            columns = [batch.column(0), batch.column(1), pa.array(container), batch.column(2), batch.column(3), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "part", "container_id", "token_from", "part_tokens", "place_from"])

    return ranked.mapInArrow(run, "id long, part long, container_id long, token_from long, part_tokens long, place_from long")
