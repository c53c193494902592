"""One group identifier for all records that are linked directly or through others.

Method: union-find runs inside each partition of links, only a spanning forest of it is kept, and
forests are merged hierarchically through partitions of bounded size.  Between two levels every
record that is no root anywhere is set aside with a pointer to one of its roots, so only roots go
up; when the remaining links fit one bounded partition, that partition finishes, and the pointers
give every record its group on the way back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.hot import attach
from strandlake.session import bounded, stage

#: Links that one task holds at a time (16 bytes each).
TASK_LINKS = 500_000
#: Roots of one record that are gathered in a row, on average; a record of more forests is met in parts.
MAX_SET = 4096
_PAIR = pa.schema([("node", pa.int64()), ("root", pa.int64())])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed pseudo-random order of identifiers: a third of any chain loses its roots per level."""
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the links (a, b): every record once, with the root of its tree (a star).

    Roots are hooked onto roots that come earlier in a mixed order, all at once, then all paths are
    compressed, until no link joins two trees.
    """
    nodes = np.unique(np.concatenate([a, b]))
    nodes = nodes[np.argsort(_mixed(nodes), kind="stable")]
    by_id = np.argsort(nodes)
    u, v = by_id[np.searchsorted(nodes, a, sorter=by_id)], by_id[np.searchsorted(nodes, b, sorter=by_id)]
    parent = np.arange(len(nodes))
    while True:
        u, v = parent[u], parent[v]
        live = u != v
        if not live.any():
            return nodes, nodes[parent]
        u, v = u[live], v[live]
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above


def _forests(limit: int):
    """Forests of a partition; it never holds more than about twice ``limit`` links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= 2 * limit:
                forest = spanning_forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
                if len(forest[0]) > limit:  # it would not shrink any more: pass it on
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest], schema=_PAIR)
                    held, size = [], 0
                else:
                    held, size = [forest], len(forest[0])
        if held:
            forest = spanning_forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest], schema=_PAIR)

    return run


def _met(forests: DataFrame, salts: int) -> tuple[DataFrame, DataFrame]:
    """(node, best, is_root; links between roots that share a node), from the forests' (node, root) pairs.

    A node of very many forests is met in ``salts`` parts first, each of which knows its best root; so
    neither a part nor the list of parts grows with the number of forests alone.
    """
    best_of = lambda c: F.array_min(F.transform(c, lambda r: F.struct(F.xxhash64(r).alias("h"), r.alias("r"))))["r"]
    by = ["node", F.pmod(F.xxhash64("root", F.lit(1)), F.lit(salts)).alias("salt")] if salts > 1 else ["node"]
    roots = forests.groupBy(*by).agg(F.collect_set("root").alias("roots"))
    roots = stage(roots.select("node", "roots", best_of("roots").alias("best"), F.array_contains("roots", F.col("node")).alias("is_root")), "forest")
    links = roots.select(F.col("best").alias("a"), F.explode("roots").alias("b"))
    if salts > 1:
        parts = roots.groupBy("node").agg(F.collect_set("best").alias("roots"), F.max("is_root").alias("is_root"))
        parts = stage(parts.select("node", "roots", best_of("roots").alias("best"), "is_root"), "forest")
        links = links.unionByName(parts.select(F.col("best").alias("a"), F.explode("roots").alias("b")))
        roots = parts
    return roots.select("node", "best", "is_root"), links.where("a <> b").distinct()


def _labels(links: DataFrame, limit: int, max_set: int, level: int = 0) -> DataFrame:
    """(node, root): every node of ``links`` (a, b) with one root of its component."""
    n = links.count()
    schema = "node long, root long"
    if n <= limit:
        return links.coalesce(1).mapInArrow(_forests(limit), schema)
    # level 0 works on the splits as they are; later ones on partitions of at most the bound
    # (by both ends: the links of one popular root go to all of them)
    forests = -(-n // limit)
    if level == 0:
        parts, forests = links, max(forests, links.rdd.getNumPartitions())  # of a plain scan
    else:
        parts = links.repartition(forests, "a", "b")
    met, above = _met(parts.mapInArrow(_forests(limit), schema), -(-forests // max_set))
    up = stage(_labels(stage(above, f"links{level + 1}"), limit, max_set, level + 1), f"labels{level + 1}")
    # a root stays a node of the level above; all others follow their pointer
    here = met.select("node", F.when(F.col("is_root"), F.col("node")).otherwise(F.col("best")).alias("via"))
    up = up.withColumnRenamed("node", "via")
    if bounded(up):
        joined = here.join(F.broadcast(up), "via", "left")
    else:
        pointed = here.groupBy("via").agg(F.count(F.lit(1)).alias("n_via")).join(up, "via", "left")
        joined = attach(here, pointed, "via", "n_via", here.count())
    return joined.select("node", F.coalesce("root", "via").alias("root"))


def connected_groups(links: DataFrame, a: str, b: str, *, task_links: int = TASK_LINKS, max_set: int = MAX_SET) -> DataFrame:
    """``id, group_id`` for every record in a link with both ends; group_id is its group's smallest id.

    Defined cases: links with a missing end are not read (a record only there does not come out); a
    record linked only with itself is its own group; repeated links and either direction make no
    difference; an empty table gives no rows; further columns are not read.  Identifiers are longs.
    """
    pairs = links.select(F.col(f"`{a}`").cast("long").alias("a"), F.col(f"`{b}`").cast("long").alias("b")).where("a is not null and b is not null")
    # a loop is a link like any other: union-find gives the record itself as root
    labels = stage(_labels(stage(pairs, "links0"), task_links, max_set), "labels0")
    groups = labels.groupBy("root").agg(F.min("node").alias("group_id"), F.count(F.lit(1)).alias("n_members"))
    return attach(labels, groups, "root", "n_members", labels.count()).select(F.col("node").alias("id"), "group_id")
