"""Per-key summaries that do not slow down when a few keys hold most rows.

Method: dense accumulator arrays.  Every input split, equal in size whatever its keys are, gives its
keys codes from a dictionary and scatter-adds its rows into dense arrays over the codes
(``numpy.bincount``).  The arrays are cut into blocks by a hash of their keys, each block with its
part of the dictionary, and the blocks are summed in a two-level distributed reduction.  A key that
holds a third of all rows costs each split what its share of rows costs, and the reduction sees one
number per split and key.  No task holds more than its own keys, so one way serves any number of
keys, and nothing is sent to the driver or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.session import stage

#: Keys (and their bytes) that a split holds at a time; beyond, it passes its blocks on and begins anew.
SPLIT_KEYS = 250_000
SPLIT_KEY_BYTES = 16 << 20
#: Entries of a task of the reduction, on average, and blocks that it sums at the first level.
TASK_ENTRIES = 500_000
FAN_IN = 512
_HASHES = 1 << 20

_LONG_MAX, _LONG_MIN = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _is_integral(t: T.DataType) -> bool:
    return isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _exact_bincount(codes: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sum of int64 ``values`` per code, wrapping as int64 does: two halves that stay under 2**53 in float64."""
    low = np.bincount(codes, weights=(values & 0xFFFFFFFF).astype(np.float64), minlength=size).astype(np.int64)
    high = np.bincount(codes, weights=(values >> 32).astype(np.float64), minlength=size).astype(np.int64)
    return low + (high << 32)


def _grown(x: np.ndarray, size: int, fill) -> np.ndarray:
    out = np.full(size, fill, x.dtype)
    out[: len(x)] = x
    return out


class _Arrays:
    """Dense accumulators over the codes of a dictionary that grows while rows come in."""

    def __init__(self, integral: Sequence[bool]):
        self.integral, self.code, self.key_bytes = integral, {}, 0
        self.fills: list = [0]
        for i in integral:
            self.fills += [0, 0, _LONG_MAX if i else np.inf, _LONG_MIN if i else -np.inf]
        kinds = [np.int64] + [k for i in integral for k in ([np.int64] * 4 if i else [np.int64, np.float64, np.float64, np.float64])]
        self.stats = [np.full(64, f, k) for f, k in zip(self.fills, kinds, strict=True)]

    def codes(self, keys: pa.Array) -> np.ndarray:
        """The codes of ``keys``; new ones (null is a key too) are given the next codes."""
        local = keys.dictionary_encode()
        words = [*local.dictionary.to_pylist(), None] if local.null_count else local.dictionary.to_pylist()
        lut = np.empty(len(words), np.int64)
        for j, w in enumerate(words):
            c = self.code.get(w)
            if c is None:
                c = self.code[w] = len(self.code)
                self.key_bytes += len(w) if w else 0
            lut[j] = c
        if len(self.code) > len(self.stats[0]):
            size = max(len(self.code), 2 * len(self.stats[0]))
            self.stats = [_grown(s, size, f) for s, f in zip(self.stats, self.fills, strict=True)]
        return lut[local.indices.fill_null(len(lut) - 1).to_numpy(zero_copy_only=False)]

    def add_rows(self, codes: np.ndarray, columns: Sequence[pa.Array]) -> None:
        size = len(self.stats[0])
        self.stats[0] += np.bincount(codes, minlength=size)
        for m, column in enumerate(columns):
            n, total, low, high = self.stats[1 + 4 * m : 5 + 4 * m]
            own = codes
            if column.null_count:
                own, column = codes[column.is_valid().to_numpy(zero_copy_only=False)], column.drop_null()
            values = column.to_numpy(zero_copy_only=False)
            n += np.bincount(own, minlength=size)
            total += _exact_bincount(own, values, size) if self.integral[m] else np.bincount(own, weights=values, minlength=size)
            np.minimum.at(low, own, values)
            np.maximum.at(high, own, values)

    def add_blocks(self, codes: np.ndarray, parts: Sequence[np.ndarray]) -> None:
        """Sums blocks whose entries have ``codes``."""
        for j, (s, p) in enumerate(zip(self.stats, parts, strict=True)):
            how = (np.add, np.add, np.minimum, np.maximum)[(j - 1) % 4] if j else np.add
            how.at(s, codes, p)

    def keys(self) -> pa.Array:
        return pa.array(list(self.code), pa.string())


def _names(integral: Sequence[bool]) -> list[tuple[str, str]]:
    """The statistics, with their types."""
    out = [("n", "bigint")]
    for m, i in enumerate(integral):
        kind = "bigint" if i else "double"
        out += [(f"c{m}", "bigint"), (f"s{m}", kind), (f"l{m}", kind), (f"h{m}", kind)]
    return out


def _key_hash(keys: pa.Array) -> np.ndarray:
    """A hash of each text below ``_HASHES``; equal texts have equal ones everywhere."""
    import zlib

    return np.array([zlib.crc32(k.encode()) % _HASHES if k is not None else 0 for k in keys.to_pylist()], np.int64)


def _blocks_of_splits(narrow: DataFrame, integral: Sequence[bool], split_keys: int, split_key_bytes: int) -> DataFrame:
    """``hash, part, k`` and the statistics: the arrays of every split, an entry per key."""
    names = _names(integral)
    schema = "hash int, part int, k string, " + ", ".join(f"{n} {t}" for n, t in names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, acc = TaskContext.get().partitionId(), _Arrays(integral)

        def passed_on() -> pa.RecordBatch:
            keys, n = acc.keys(), len(acc.code)
            columns = [pa.array(_key_hash(keys), pa.int32()), pa.array(np.full(n, part), pa.int32()), keys, *[pa.array(s[:n]) for s in acc.stats]]
            return pa.RecordBatch.from_arrays(columns, names=["hash", "part", "k", *[n for n, _ in names]])

        for batch in batches:
            if batch.num_rows:
                acc.add_rows(acc.codes(batch.column(0)), batch.columns[1:])
            if len(acc.code) > split_keys or acc.key_bytes > split_key_bytes:
                yield passed_on()
                acc = _Arrays(integral)
        if acc.code:
            yield passed_on()

    return narrow.mapInArrow(scan, schema)


def _summed(blocks: DataFrame, by: list, integral: Sequence[bool]) -> DataFrame:
    """One entry per key of each group of ``by``, which no key is in two of (but for the first level's fans)."""
    names = [n for n, _ in _names(integral)]
    schema = "hash int, part int, k string, " + ", ".join(f"{n} {t}" for n, t in _names(integral))

    def merge(table: pa.Table) -> pa.Table:
        acc = _Arrays(integral)
        codes = acc.codes(table.column("k").combine_chunks())
        acc.add_blocks(codes, [table.column(n).to_numpy() for n in names])
        n, first = len(acc.code), np.zeros(len(acc.code), np.int64)
        first[codes] = np.arange(len(codes))
        at = pa.array(first)
        return pa.Table.from_arrays([table.column("hash").take(at), table.column("part").take(at), acc.keys(), *[pa.array(s[:n]) for s in acc.stats]], names=["hash", "part", "k", *names])

    return blocks.groupBy(*by).applyInArrow(merge, schema)


def _aggregated(df: DataFrame, key: str, measures: Sequence[str], split_keys: int, split_key_bytes: int, task_entries: int, fan_in: int) -> tuple[DataFrame, int]:
    """(one row per key, number of all rows)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    integral = [_is_integral(types[m]) for m in measures]
    narrow = df.select(F.col(f"`{key}`").alias("k"), *[F.col(f"`{m}`").cast("long" if i else "double").alias(f"m{j}") for j, (m, i) in enumerate(zip(measures, integral, strict=True))])
    blocks = stage(_blocks_of_splits(narrow, integral, split_keys, split_key_bytes), "blocks")
    entries, parts, total = blocks.agg(F.count(F.lit(1)), F.coalesce(F.max("part"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    task = F.pmod("hash", F.lit(max(1, min(_HASHES, -(-entries // task_entries))))).alias("task")
    if parts >= fan_in:
        blocks = _summed(blocks, [task, F.floor(F.col("part") / fan_in).alias("fan")], integral)
    merged = _summed(blocks, [task], integral)
    out = [F.col("k").alias(key), F.col("n").alias("n_rows")]
    for j, m in enumerate(measures):
        seen = F.col(f"c{j}") > 0
        out += [F.col(f"c{j}").alias(f"{m}_n"), *[F.when(seen, F.col(f"{x}{j}")).alias(f"{m}_{y}") for x, y in (("s", "sum"), ("l", "min"), ("h", "max"))]]
    return merged.select(*out), total


def dense_key_aggregate(
    df: DataFrame,
    key: str,
    measures: Sequence[str],
    *,
    split_keys: int = SPLIT_KEYS,
    split_key_bytes: int = SPLIT_KEY_BYTES,
    task_entries: int = TASK_ENTRIES,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per key: ``key``, ``n_rows`` and, per measure m, ``m_n``, ``m_sum``, ``m_min``, ``m_max``.

    ``key`` is a string column; ``measures`` are integral or floating columns.  Sums of integral
    measures are exact (they wrap at 2**63, as int64 does).

    Defined cases: a null key is a key of its own (its row has a null key); null measures count in
    ``n_rows`` only; a key without any value of a measure has ``m_n`` 0 and null sum, minimum and
    maximum; NaN spreads in floating sums, minima and maxima; repeated rows count as often as they
    stand there; an empty table gives no rows; other columns, whatever their names, are not read.

    The bounds only say when a split passes its blocks on and how many tasks sum them; they never
    change the result, but for the order in which floating values are added.
    """
    return _aggregated(df, key, measures, split_keys, split_key_bytes, task_entries, fan_in)[0]


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """Non-null keys holding more than ``share`` of all rows (null keys count as rows), with ``n_rows``.

    Rows, nulls, ties and empty tables are treated as by :func:`dense_key_aggregate`; an empty
    table has no heavy key.
    """
    counts, total = _aggregated(df, key, [], SPLIT_KEYS, SPLIT_KEY_BYTES, TASK_ENTRIES, FAN_IN)
    return counts.where(F.col(f"`{key}`").isNotNull() & (F.col("n_rows") > F.lit(share * total)))
