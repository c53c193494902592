"""One surviving record per group of duplicates, with the best value of each field.

Method: iterative truth discovery.  Each source votes for the values its records claim; votes count by
the source's reliability, and a source is the more reliable the larger the support of its values is.
Both are estimated in turn until the reliabilities stand still; the survivor takes the value with
the largest support in each field.  The survivor's base record (its place in the sources) is the most
complete, then the most recent, then the most trusted claim; the same order decides between values
of equal support.

Values are compared by 64-bit hashes of their normal form while voting; the values themselves are
fetched once, for the winners.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.hot import attach
from strandlake.session import bounded, maybe_broadcast, stage

#: Claims that one group may have to be judged within a row; larger groups are judged by joins.
ROW_CLAIMS = 4096
#: Sources whose reliabilities are sent to every task (8 bytes each); more are judged by joins.
MAX_SOURCES = 1_000_000
#: The estimates settle within a few rounds; sources that never do are reported (``converged``), not awaited.
MAX_ROUNDS = 100
TOLERANCE = 1e-3
#: A source starts as if it had been right once and wrong once.
PRIOR = 1.0


def present(value: Column, kind: str) -> Column:
    """``value``, or null where it is missing: null, and for text also blank and ``.``."""
    if kind != "string":
        return value
    bare = F.regexp_replace(value, r"\A\s+|\s+\z", "")
    return F.when((bare != "") & (bare != "."), value)


def normal_form(value: Column, kind: str) -> Column:
    """What counts as the same claim: text without white space and case."""
    return F.upper(F.regexp_replace(value, r"\s+", "")) if kind == "string" else value


def _flat(batch: pa.RecordBatch, n_fields: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per field: (row, source code, value hash, place in the row's list) of the claims, each once, at its first place."""
    lists = batch.column(batch.schema.get_field_index("claims"))
    flat, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    code = flat.field(0).to_numpy(zero_copy_only=False)
    for i in range(n_fields):
        values = flat.field(i + 1)
        keep = values.is_valid().to_numpy(zero_copy_only=False)
        r, c, p, h = row[keep], code[keep], place[keep], values.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        by = np.lexsort((p, c, h, r))
        r, c, h, p = r[by], c[by], h[by], p[by]
        once = np.r_[True, (r[1:] != r[:-1]) | (h[1:] != h[:-1]) | (c[1:] != c[:-1])] if len(r) else np.zeros(0, bool)
        yield r[once], c[once], h[once], p[once]


def _support(row: np.ndarray, code: np.ndarray, value: np.ndarray, weight: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the value of each claim, support of each value as a share of its field's votes)."""
    new = np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])] if len(row) else np.zeros(0, bool)
    nth = np.cumsum(new) - 1
    votes = np.bincount(nth, weight[code], minlength=int(new.sum()))
    total = np.bincount(row[new], votes, minlength=n_rows)
    return nth, votes / total[row[new]]


class TruthDiscovery:
    """Survivors of ``groups`` (``group``, ``source``, ``item``: which records stand for one thing).

    ``records`` has ``source``, ``item`` and the ``fields``; ``recency`` is a long column expression
    over it (larger is newer) and ``trust`` a table (``source``, ``rank``; 1 is best).

    Defined cases: an entry with a null part or without a record claims nothing, and a group without
    any claim does not come out; an entry listed twice is one claim; several records of one source
    may claim several values, each once; a missing value is no claim, and a field nobody claims is
    null; ties between base records are decided by completeness, recency (null last), rank (unranked
    last), source in byte order, item; values of equal support (to 12 digits) by the first of their
    claims in that order; empty tables give no rows; further columns are not read.

    ``rounds_used`` and ``converged`` tell how the estimation ended.
    """

    def __init__(self, groups: DataFrame, records: DataFrame, trust: DataFrame, fields: Mapping[str, str], recency: Column, *, row_claims: int = ROW_CLAIMS, max_sources: int = MAX_SOURCES, rounds: int = MAX_ROUNDS):
        self._fields, self._records, self._rounds, self.rounds_used, self.converged = fields, records, rounds, 0, False
        entries = groups.where("group is not null and source is not null and item is not null").groupBy("group", "source", "item").count().drop("count")
        entries = stage(entries, "entries")
        sources = stage(entries.groupBy("source").agg(F.count(F.lit(1)).alias("n_entries")), "sources")
        n_sources = sources.count()
        # codes 0..n-1 for the reliabilities' vector; only made if it may be sent to tasks at all
        self._by_vector = n_sources <= max_sources and bounded(sources, max_sources)
        names = sorted(r.source for r in sources.collect()) if self._by_vector else []
        ranks = trust.groupBy("source").agg(F.min("rank").alias("rank"))
        told = sources.join(maybe_broadcast(ranks), "source", "left")
        if self._by_vector:
            codes = records.sparkSession.createDataFrame(pa.table({"source": pa.array(names, pa.string()), "code": pa.array(range(len(names)), pa.int64())}))
            told = told.join(F.broadcast(codes), "source")
        else:
            told = told.withColumn("code", F.xxhash64("source"))
        self._told = told = stage(told, "told")
        hashes = [F.when(present(F.col(f"`{f}`"), k).isNotNull(), F.xxhash64(F.lit(i), normal_form(F.col(f"`{f}`"), k))).alias(f"h{i}") for i, (f, k) in enumerate(fields.items())]
        facts = records.where("source is not null and item is not null").select("source", "item", recency.alias("recency"), *hashes)
        missing = sum((F.when(F.col(f"h{i}").isNull(), 1).otherwise(0) for i in range(len(fields))), F.lit(0))
        order = F.struct(missing.alias("missing"), (-F.coalesce(F.col("recency"), F.lit(-(2**62)))).alias("age"), F.coalesce(F.col("rank").cast("long"), F.lit(2**62)).alias("rank"), F.col("source"), F.col("item"))
        # one source may have any share of the entries, so its rank and code come by a join that splits it
        found = attach(entries.join(facts, ["source", "item"]), told, "source", "n_entries", entries.count())
        claims = found.select("group", "code", *[f"h{i}" for i in range(len(fields))], order.alias("order"))

        # counted on the claims: one record may have been delivered any number of times
        claims = stage(claims, "claims")
        large = stage(claims.groupBy("group").count().where(F.col("count") > row_claims).select("group"), "large")
        hs = [f"h{i}" for i in range(len(fields))]
        if not self._by_vector:
            small_claims, self._long = None, claims
        elif large.isEmpty():
            small_claims, self._long = claims, None
        else:
            large = maybe_broadcast(large)
            small_claims, self._long = claims.join(large, "group", "left_anti"), claims.join(large, "group", "left_semi")
        # one shuffle both gathers the claims of a group, in order, and finds its base record
        if small_claims is None:
            self._rows = None
        else:
            listed = small_claims.groupBy("group").agg(F.array_sort(F.collect_set(F.struct("order", "code", *hs))).alias("x"))
            plain = F.transform("x", lambda x: F.struct(x["code"].alias("code"), *[x[h].alias(h) for h in hs]))
            self._rows = stage(listed.select("group", F.get("x", F.lit(0))["order"].alias("base"), plain.alias("claims")), "groups")
        self._weigh(len(names))

    def _weigh(self, n_sources: int) -> None:
        """Alternates between support and reliabilities until no reliability moves by more than the tolerance."""
        k = len(self._fields)
        spark = self._records.sparkSession
        if not self._by_vector:
            self._n_votes = self._long.count() * k
            return self._weigh_by_joins(k)
        self.weights = np.ones(n_sources)
        self._n_votes = 0 if self._long is None else self._long.count() * k
        for self.rounds_used in range(1, self._rounds + 1):
            shared = spark.sparkContext.broadcast(self.weights)

            def errors(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                weight = shared.value
                wrong, told = np.zeros(len(weight)), np.zeros(len(weight))
                for batch in batches:
                    for row, code, value, _ in _flat(batch, k):
                        nth, support = _support(row, code, value, weight, batch.num_rows)
                        wrong += np.bincount(code, 1 - support[nth], minlength=len(weight))
                        told += np.bincount(code, minlength=len(weight))
                own = np.flatnonzero(told)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(wrong[own]), pa.array(told[own])], names=["code", "wrong", "told"])

            parts = [self._rows.select("claims").mapInArrow(errors, "code long, wrong double, told double")]
            if self._long is not None:
                parts.append(self._long_errors(self._long_weights(), k))
            sums = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            found = sums.groupBy("code").agg(F.sum("wrong").alias("wrong"), F.sum("told").alias("told")).toArrow()  # a row per source: bounded
            new = np.ones(n_sources)
            at = found["code"].to_numpy()
            new[at] = self._reliability(found["wrong"].to_numpy(), found["told"].to_numpy())
            moved = np.abs(new - self.weights).max(initial=0)
            self.weights = new
            self.converged = bool(moved <= TOLERANCE)
            if self.converged:
                break

    @staticmethod
    def _reliability(wrong, told):
        """The negative logarithm of the (smoothed) share of votes that went against the source."""
        return -np.log((wrong + PRIOR) / (told + 2 * PRIOR))

    def _votes(self, long_claims: DataFrame, weights: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(claims in long form, support of each value) of groups too large for a row."""
        cells = F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"h{i}").alias("value")) for i in range(k)])
        cast = long_claims.select("group", "code", "order", F.explode(cells).alias("x")).where("x.value is not null").groupBy("group", "code", "x.field", "x.value").agg(F.min("order").alias("order"))
        weighed = attach(cast, weights, "code", "n_votes", self._n_votes)
        votes = weighed.groupBy("group", "field", "value").agg(F.sum("weight").alias("votes"), F.min("order").alias("order"))
        total = votes.groupBy("group", "field").agg(F.sum("votes").alias("total"))
        return cast, votes.join(total, ["group", "field"]).select("group", "field", "value", "order", (F.col("votes") / F.col("total")).alias("support"))

    def _long_errors(self, weights: DataFrame, k: int) -> DataFrame:
        cast, support = self._votes(self._long, weights, k)
        support = maybe_broadcast(stage(support.drop("order"), "support"))
        return cast.drop("order").join(support, ["group", "field", "value"]).groupBy("code").agg(F.sum(1 - F.col("support")).alias("wrong"), F.count(F.lit(1)).cast("double").alias("told"))

    def _long_weights(self) -> DataFrame:
        """``code, weight, n_votes``: the weights now, with how many claims of large groups a source has (at most)."""
        if not self._by_vector:
            return self._weight_table
        now = self._records.sparkSession.createDataFrame(pa.table({"code": pa.array(range(len(self.weights)), pa.int64()), "weight": pa.array(self.weights)}))
        return F.broadcast(now).withColumn("n_votes", F.lit(0).cast("long"))

    def _weigh_by_joins(self, k: int) -> None:
        counted = self._long.groupBy("code").agg((F.count(F.lit(1)) * k).alias("n_votes"))
        self._weight_table = stage(counted.select("code", F.lit(1.0).alias("weight"), "n_votes"), "weights")
        for self.rounds_used in range(1, self._rounds + 1):
            sums = self._long_errors(self._weight_table, k)
            new = sums.select("code", (-F.log((F.col("wrong") + PRIOR) / (F.col("told") + 2 * PRIOR))).alias("new"))
            both = stage(self._weight_table.join(new, "code", "left").select("code", F.coalesce("new", F.lit(1.0)).alias("weight"), "n_votes", F.abs(F.coalesce("new", F.lit(1.0)) - F.col("weight")).alias("moved")), "weights")
            self._weight_table = both.select("code", "weight", "n_votes")
            self.converged = (both.agg(F.max("moved")).first()[0] or 0) <= TOLERANCE
            if self.converged:
                break

    def reliabilities(self) -> DataFrame:
        """``source, weight, converged``: every source of an entry with its reliability in the end.

        A source without a claim keeps its first weight, 1.
        """
        if self._by_vector:
            now = self._records.sparkSession.createDataFrame(pa.table({"code": pa.array(range(len(self.weights)), pa.int64()), "weight": pa.array(self.weights)}))
        else:
            now = self._weight_table.select("code", "weight")
        return self._told.select("source", "code").join(now, "code", "left").select("source", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.lit(self.converged).alias("converged"))

    def decided(self) -> DataFrame:
        """Per group: ``group``, ``base`` (missing, age, rank, source, item), ``win`` and ``support`` (arrays by field)."""
        k, parts = len(self._fields), []
        if self._rows is not None:
            shared = self._records.sparkSession.sparkContext.broadcast(self.weights)

            def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                weight = shared.value
                for batch in batches:
                    n = batch.num_rows
                    win, sup, has = np.zeros((n, k), np.int64), np.zeros((n, k)), np.zeros((n, k), bool)
                    for i, (row, code, value, place) in enumerate(_flat(batch, k)):
                        nth, support = _support(row, code, value, weight, n)
                        first = np.flatnonzero(np.r_[True, nth[1:] != nth[:-1]]) if len(nth) else np.zeros(0, int)
                        r, v = row[first], value[first]
                        earliest = np.minimum.reduceat(place, first) if len(first) else first
                        by = np.lexsort((earliest, -support.round(12), r))
                        r, v, s = r[by], v[by], support[by]
                        top = np.r_[True, r[1:] != r[:-1]] if len(r) else np.zeros(0, bool)
                        win[r[top], i], sup[r[top], i], has[r[top], i] = v[top], s[top], True
                    gone = ~has.ravel()
                    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * k)
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), mask=gone)) for x in (win, sup)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["group", "base", "win", "support"])

            base = "struct<missing:int,age:bigint,rank:bigint,source:string,item:bigint>"
            parts.append(self._rows.select("group", F.col("base").cast(base).alias("base"), "claims").mapInArrow(decide, f"group long, base {base}, win array<long>, support array<double>"))
        if self._long is not None:
            _, support = self._votes(self._long, self._long_weights(), k)
            best = support.groupBy("group", "field").agg(F.min(F.struct((-F.round("support", 12)).alias("s"), "order", "value", "support")).alias("b"))
            at = lambda i, what: F.max(F.when(F.col("field") == i, F.col(f"b.{what}")))
            wide = best.groupBy("group").agg(F.array(*[at(i, "value") for i in range(k)]).alias("win"), F.array(*[at(i, "support") for i in range(k)]).alias("support"))
            bases = self._long.groupBy("group").agg(F.min("order").alias("base"))
            none = F.array_repeat(F.lit(None), k)
            parts.append(bases.join(wide, "group", "left").select("group", "base", F.coalesce("win", none.cast("array<bigint>")).alias("win"), F.coalesce("support", none.cast("array<double>")).alias("support")))
        return parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1].select("group", F.col("base").cast(parts[0].schema["base"].dataType).alias("base"), "win", "support"))

    def survivors(self, groups: DataFrame) -> DataFrame:
        """``group, source, item`` of the base record, the best value of each field, and ``support``.

        ``groups`` is the table of entries the object was made from; of several ways to write the
        winning value the smallest is taken.
        """
        decided = stage(self.decided(), "decided")
        values = self._records.where("source is not null and item is not null").select("source", "item", *[F.col(f"`{f}`").alias(f"v{i}") for i, f in enumerate(self._fields)])
        backed = groups.where("group is not null").select("group", "source", "item").distinct().join(values, ["source", "item"]).join(decided.select("group", "win"), "group")
        picks = []
        for i, (f, kind) in enumerate(self._fields.items()):
            v = F.col(f"v{i}")
            h = F.when(present(v, kind).isNotNull(), F.xxhash64(F.lit(i), normal_form(v, kind)))
            picks.append(F.min(F.when(h == F.get("win", F.lit(i)), v)).alias(f))
        best = backed.groupBy("group").agg(*picks)
        return decided.select("group", F.col("base.source").alias("source"), F.col("base.item").alias("item"), "support").join(best, "group").select("group", "source", "item", *self._fields, "support")


def micros_of(stamp: str) -> Column:
    """A timestamp without zone as microseconds, independent of the session's zone."""
    c = F.col(stamp)
    seconds = F.unix_date(F.to_date(c)).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def entries_of(merged: DataFrame, group: str, listed: str, source: str, item: str) -> DataFrame:
    """One row per entry of an array of structs: ``group, source, item``."""
    return merged.select(F.col(group).alias("group"), F.explode(listed).alias("e")).select("group", F.col(f"e.{source}").alias("source"), F.col(f"e.{item}").alias("item"))


def field_kinds(names: Sequence[str], df: DataFrame) -> dict[str, str]:
    kinds = dict(df.dtypes)
    return {n: kinds[n] for n in names}
