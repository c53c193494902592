"""Reading files whose schemas drift into one table, with a report of every change.

Method: rescue-column ingestion.  A target schema is enforced; what it does not know or cannot cast
is kept as JSON in a rescue column; approved fields are promoted to typed columns by replaying the
rescued values.

The same step finds the changes: the schema in force for a file is what the file before it in its
pipeline declared.  Enforcing it on the file's own declarations leaves a rescued remainder - unknown
fields, fields that do not fit, fields that are gone - and replaying the remainder gives the report.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.neighbours import with_next
from strandlake.session import maybe_broadcast, stage

RESCUED = "_rescued"
PROMOTED = "_promoted"
_ENTRY = "array<struct<field:string,value:string>>"
_SPEC = "struct<field_id:string,number:string,type:string,description:string>"
_DECLARED = f"struct<new:{_SPEC},old:{_SPEC}>"


def normal_number(number: Column) -> Column:
    """The header rule for Number: ``A R G .`` or a whole number (``01`` is 1), else ``.``."""
    s = F.regexp_replace(number.cast("string"), r"\A\s+|\s+\z", "")
    return F.when(s.isin("A", "R", "G", "."), s).when(s.rlike(r"\A[0-9]+\z"), F.regexp_replace(s, r"\A0+(?=[0-9])", "")).otherwise(F.lit("."))


def normal_type(kind: Column) -> Column:
    """The header rule for Type: one of five names exactly, else ``String``."""
    return F.when(kind.isin("Integer", "Float", "Flag", "Character", "String"), kind).otherwise(F.lit("String"))


def declared_fields(headers: DataFrame) -> DataFrame:
    """One row per (file_id, field_id): pipeline, file_no, number and type by the header rule, description.

    Of several lines with one id in a file the lowest line_no counts (ties: the smallest content).
    Lines without file_id or id declare nothing.
    """
    line = F.struct(F.col("line_no"), normal_number(F.col("number")).alias("number"), normal_type(F.col("type")).alias("type"), F.col("description"), F.col("pipeline"), F.col("file_no"))
    rows = headers.where("file_id is not null and id is not null").groupBy("file_id", F.col("id").alias("field_id")).agg(F.min(line).alias("l"))
    return rows.select("file_id", "field_id", "l.number", "l.type", "l.description", "l.pipeline", "l.file_no")


def _files(headers: DataFrame) -> DataFrame:
    files = headers.where("file_id is not null").groupBy("file_id").agg(F.min(F.struct("pipeline", "file_no")).alias("f")).select("file_id", "f.pipeline", "f.file_no")
    return with_next(files, ["pipeline"], "file_no", "file_id")


def enforce_declared(headers: DataFrame) -> DataFrame:
    """What is rescued when each file's declarations are read under the schema of the file before.

    One row per (file_id, field_id) that differs, with ``_rescued``: the ``new`` and the ``old``
    declaration as JSON, each left out where the field is absent.  Both sides meet in one grouping
    by (file_id, field_id), so neither a long pipeline nor a common field makes a hot group.
    """
    declared, files = declared_fields(headers), _files(headers)
    spec = F.struct("field_id", "number", "type", "description")
    both = declared.join(files.select("file_id", "next_file_id", "is_first"), "file_id")
    none = F.lit(None)
    sides = F.array(
        F.struct(F.when(~F.col("is_first"), F.col("file_id")).alias("at"), spec.alias("new"), F.when(none.cast("boolean"), spec).alias("old")),
        F.struct(F.col("next_file_id").alias("at"), F.when(none.cast("boolean"), spec).alias("new"), spec.alias("old")),
    )
    met = both.select("field_id", F.explode(sides).alias("x")).where("x.at is not null").groupBy(F.col("x.at").alias("file_id"), "field_id").agg(F.max("x.new").alias("new"), F.max("x.old").alias("old"))
    rest = met.where("new is null or old is null or new.number <> old.number or new.type <> old.type")
    return rest.select("file_id", "field_id", F.to_json(F.struct("new", "old")).alias(RESCUED))


@dataclass(frozen=True)
class _Replayed:
    """The rescued remainders of all files, read back: fields that are new, gone, or differ."""

    fresh: DataFrame
    gone: DataFrame
    kept: DataFrame

    @classmethod
    def of(cls, rescued: DataFrame) -> _Replayed:
        rest = rescued.withColumn("__r", F.from_json(RESCUED, _DECLARED)).select("file_id", "field_id", RESCUED, F.col("__r.new").alias("new"), F.col("__r.old").alias("old"))
        gone = rest.where("new is null").select("file_id", "field_id", "old", RESCUED, F.col("old.description").alias("description"))
        # of several fields that have gone with one description the smallest id is the predecessor
        before = gone.where("description is not null").groupBy("file_id", "description").agg(F.min("old").alias("was"))
        fresh = rest.where("old is null").select("file_id", "field_id", "new", RESCUED, F.col("new.description").alias("description")).join(before, ["file_id", "description"], "left")
        return cls(fresh, gone, rest.where("new is not null and old is not null"))


def schema_changes(headers: DataFrame, rescued: DataFrame | None = None) -> DataFrame:
    """``file_id, field_id, change, _rescued``: each change of a file against the one before it.

    ``change`` is ``added``, ``removed``, ``renamed``, ``number`` or ``type``.  A field absent
    before is ``renamed`` if its non-null description is that of a field that has gone (of several,
    the smallest id is its predecessor); number and type are compared with the predecessor's.
    ``rescued`` is the (stored) result of :func:`enforce_declared`, if it is there already.

    ``headers`` needs file_id, pipeline, file_no, line_no, id, number, type, description.
    Defined cases: null number and type count as ``.`` and ``String``; a null description renames
    nothing; a null pipeline is a pipeline; files with equal file_no follow each other by file_id;
    the first file of a pipeline has no changes; repeated lines change nothing; no lines, no rows;
    further columns are not read.
    """
    r = _Replayed.of(stage(enforce_declared(headers), "drift") if rescued is None else rescued)
    after = r.fresh.where("description is not null").select("file_id", "description").distinct()
    differs = lambda a, b, what: F.when(F.col(f"{a}.{what}") != F.col(f"{b}.{what}"), F.lit(what))
    per_fresh = r.fresh.select("file_id", "field_id", RESCUED, F.array_compact(F.array(F.when(F.col("was").isNull(), "added").otherwise("renamed"), differs("new", "was", "number"), differs("new", "was", "type"))).alias("c"))
    per_gone = r.gone.join(after, ["file_id", "description"], "left_anti").select("file_id", "field_id", RESCUED, F.array(F.lit("removed")).alias("c"))
    per_kept = r.kept.select("file_id", "field_id", RESCUED, F.array_compact(F.array(differs("new", "old", "number"), differs("new", "old", "type"))).alias("c"))
    return per_fresh.unionByName(per_gone).unionByName(per_kept).select("file_id", "field_id", F.explode("c").alias("change"), RESCUED)


def _next_rename(asked: DataFrame, renames: DataFrame, step: int = 1024) -> DataFrame:
    """``asked`` with ``next_file``: the first file after its own, in its pipeline, that renames its field.

    Both have pipeline, field_id, file_no, file_id.  Rows are sorted within ranges of ``step`` file
    numbers; across ranges one row per range is looked at.
    """
    tile = F.coalesce(F.floor(F.col("file_no") / F.lit(step)).cast("long"), F.lit(-(2**62))).alias("tile")
    keys, place = ["pipeline", "field_id"], ["file_no", "file_id"]
    own = [c for c in asked.columns if c not in (*keys, *place)]
    kept = F.struct(*[F.col(c) for c in own]) if own else F.struct(F.lit(1).alias("one"))
    rows = asked.select(*keys, *place, tile, F.lit(False).alias("is_rename"), kept.alias("own"))
    rows = rows.unionByName(renames.select(*keys, *place, tile, F.lit(True).alias("is_rename")), allowMissingColumns=True)
    renamed = F.when(F.col("is_rename"), F.col("file_id"))
    # backwards, so that what comes before a row is what is later; a file's own renames come after it
    back = [F.col("file_no").desc_nulls_last(), F.col("file_id").desc(), F.col("is_rename")]
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("in_tile", F.last(renamed, True).over(before(Window.partitionBy(*keys, "tile").orderBy(*back))))
    heads = renames.select(*keys, *place, tile).groupBy(*keys, "tile").agg(F.min(F.struct(*place)).getField("file_id").alias("head"))
    tiles = rows.groupBy(*keys, "tile").agg(F.lit(0).alias("z")).drop("z")
    null_safe = lambda a, b, names: reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names])
    across = tiles.join(heads, null_safe(tiles, heads, [*keys, "tile"]), "left").select(*[tiles[c] for c in (*keys, "tile")], "head")
    across = across.withColumn("later", F.last("head", True).over(before(Window.partitionBy(*keys).orderBy(F.col("tile").desc()))))
    across = across.select(*[F.col(c).alias(f"__{c}") for c in (*keys, "tile")], "later")
    rows = rows.where("not is_rename").join(across, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*keys, "tile")]))
    return rows.select(*keys, *place, *[F.col(f"own.{c}").alias(c) for c in own], F.coalesce("in_tile", "later").alias("next_file"))


def canonical_fields(headers: DataFrame) -> DataFrame:
    """``file_id, field_id, canonical, number, type``: the name a field of a file has in the one table.

    A field of a file takes the name that the first later file of its pipeline to rename it gives it,
    then that name's own next rename, and so on to the last.  Where a file gives one field two names,
    the smaller counts.  A chain only goes on to later files, so it ends, and pointer doubling follows
    it in as many rounds as its length has binary digits.  A null pipeline is a pipeline.
    """
    declared = stage(declared_fields(headers), "declared")
    fresh = _Replayed.of(stage(enforce_declared(headers), "drift")).fresh.where("was is not null")
    files = _files(headers).select("file_id", "pipeline", "file_no")
    edges = fresh.groupBy("file_id", F.col("was.field_id").alias("old_id")).agg(F.min("field_id").alias("name")).join(files, "file_id")
    edges = stage(edges, "renames")
    asked = declared.select("pipeline", "field_id", "file_no", "file_id", F.lit(None).cast("string").alias("old_id"))
    asked = asked.unionByName(edges.select("pipeline", F.col("name").alias("field_id"), "file_no", "file_id", "old_id"))
    found = stage(_next_rename(asked, edges.select("pipeline", F.col("old_id").alias("field_id"), "file_no", "file_id")), "next")
    chain = found.where("old_id is not null").select("file_id", "old_id", F.col("field_id").alias("name"), "next_file")
    while True:  # every round doubles how far a rename looks ahead
        chain = stage(chain, "chain")
        if chain.where("next_file is not null").isEmpty():
            break
        far = chain.select(F.col("file_id").alias("next_file"), F.col("old_id").alias("name"), F.col("name").alias("far_name"), F.col("next_file").alias("far_file"))
        chain = chain.join(far, ["next_file", "name"], "left").select("file_id", "old_id", F.coalesce("far_name", "name").alias("name"), F.col("far_file").alias("next_file"))
    last = chain.select(F.col("file_id").alias("next_file"), F.col("old_id").alias("field_id"), F.col("name").alias("last_name"))
    own = found.where("old_id is null").select("file_id", "field_id", "next_file").join(last, ["next_file", "field_id"], "left")
    named = declared.select("file_id", "field_id", "number", "type").join(own.select("file_id", "field_id", "last_name"), ["file_id", "field_id"])
    return named.select("file_id", "field_id", F.coalesce("last_name", "field_id").alias("canonical"), "number", "type")


@dataclass(frozen=True)
class TargetField:
    """A typed column of the target table: ``number`` 0 or 1 gives a scalar, everything else a list."""

    name: str
    number: str
    type: str

    @property
    def spark_type(self) -> str:
        return {"Integer": "bigint", "Float": "double", "Flag": "boolean"}.get(self.type, "string")

    def typed(self, raw: Column) -> tuple[Column, Column]:
        """The value of ``raw`` as this column, and whether it is faithful."""
        if self.type == "Flag":
            return F.when(raw.isNull() | (raw == ""), F.lit(True)), raw.isNull() | (raw == "")
        if self.number in ("0", "1"):
            value = raw.try_cast(self.spark_type)
            return F.when(raw != ".", value), (raw == ".") | value.isNotNull()
        parts = F.split(raw, ",")
        values = F.transform(parts, lambda x: F.when(x != ".", x.try_cast(self.spark_type)))
        good = raw.isNotNull() & F.forall(parts, lambda x: (x == ".") | x.try_cast(self.spark_type).isNotNull())
        return F.when(good & (raw != "."), values), good


def target_fields(names: DataFrame) -> DataFrame:
    """``canonical, number, type, files``: every field of the one table with its most frequent declaration.

    ``names`` is the result of :func:`canonical_fields`.
    """
    counts = names.groupBy("canonical", "number", "type").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("canonical").agg(F.sum("n").alias("files"), F.max(F.struct("n", "number", "type")).alias("m"))
    return best.select("canonical", "m.number", "m.type", "files")


def choose_target(headers: DataFrame, max_fields: int = 48, names: DataFrame | None = None) -> list[TargetField]:
    """The ``max_fields`` fields that most files declare, each with its most frequent number and type.

    ``names`` is the result of :func:`canonical_fields`, if it is there already.

    The bound is on columns of the table, not on data: :func:`promote_all` types the fields beyond it.
    """
    names = canonical_fields(headers) if names is None else names
    rows = target_fields(names).orderBy(F.desc("files"), "canonical").limit(max_fields).collect()
    return [TargetField(r.canonical, r.number, r.type) for r in rows]


def ingest(records: DataFrame, headers: DataFrame, target: Sequence[TargetField], text: str = "info_text", keep: Sequence[str] = ("file_id", "vcf_rec"), names: DataFrame | None = None, fitted: str | None = None) -> DataFrame:
    """``records`` as one typed table: the columns ``keep``, one per target field, and ``_rescued``.

    ``text`` holds ``KEY=VALUE;KEY;...``.  Keys are renamed to their canonical names by the header
    of the record's file, then cast to the target.  ``_rescued`` is a JSON list of the entries that
    are unknown or do not fit (null if there are none), so nothing is lost.  ``fitted`` names a column
    for the fields that were taken, if it is wanted.

    Defined cases: a null, blank or ``.`` text is a record without fields; ``.`` is a null value; a
    repeated key counts once and its further values are rescued; a record whose file has no header
    keeps its own names; an empty table stays empty.
    """
    names = canonical_fields(headers) if names is None else names
    names = names.where("canonical <> field_id").groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("field_id", "canonical"))).alias("__names"))
    entries = F.transform(
        F.filter(F.split(F.coalesce(F.trim(F.col(text)), F.lit("")), ";"), lambda e: (e != "") & (e != ".")),
        lambda e: F.struct(F.substring_index(e, "=", 1).alias("field"), F.when(e.contains("="), F.regexp_replace(e, r"\A[^=]*=", "")).alias("value")),
    )
    rows = records.select(*keep, F.col("file_id").alias("__file"), entries.alias("__raw")).join(names.withColumnRenamed("file_id", "__file"), "__file", "left")
    renamed = F.transform("__raw", lambda e: F.struct(F.coalesce(F.try_element_at("__names", e["field"]), e["field"]).alias("field"), e["value"].alias("value")))
    return _fit(rows.select(*keep, renamed.alias("__all")), target, "__all", keep, fitted)


def _fit(df: DataFrame, target: Sequence[TargetField], entries: str, keep: Sequence[str], fitted_as: str | None = None) -> DataFrame:
    """Moves entries into typed columns; what does not fit goes (back) to the rescue column."""
    earlier = lambda e, i: F.exists(F.slice(entries, 1, i), lambda b: b["field"] == e["field"])
    # the first entry of each field, looked up by the columns
    df = df.withColumn("__first", F.map_from_entries(F.filter(entries, lambda e, i: e["field"].isNotNull() & ~earlier(e, i))))
    columns, taken = [], []
    for t in target:
        present = F.map_contains_key("__first", F.lit(t.name))
        value, good = t.typed(F.try_element_at("__first", F.lit(t.name)))
        columns.append(F.when(present, value).alias(t.name))
        taken.append(F.when(present & good, F.lit(t.name)))
    fitted = F.array_compact(F.array(*taken)) if taken else F.array().cast("array<string>")
    # an entry stays if its field did not fit, or if an earlier entry of the field was taken
    rest = F.filter(entries, lambda e, i: ~F.array_contains("__fitted", e["field"]) | earlier(e, i))
    out = df.select(*[F.col(f"`{c}`") for c in keep], *columns, F.col(entries), fitted.alias("__fitted"))
    out = out.withColumn(RESCUED, F.when(F.size(rest) > 0, F.to_json(rest))).drop(entries)
    return out.withColumnRenamed("__fitted", fitted_as) if fitted_as else out.drop("__fitted")


def promote(table: DataFrame, fields: Sequence[TargetField]) -> DataFrame:
    """``table`` with approved fields as typed columns, replayed from ``_rescued``.

    Values that do not fit stay rescued. A field that is a column already is refused.
    """
    clash = {f.name for f in fields} & set(table.columns)
    if clash:
        raise ValueError(f"already columns: {sorted(clash)}")
    keep = [c for c in table.columns if c != RESCUED]
    entries = F.coalesce(F.from_json(RESCUED, _ENTRY), F.array().cast(_ENTRY))
    return _fit(table.withColumn("__all", entries), fields, "__all", keep)


_KINDS = {"integers": "Integer", "floats": "Float", "flag": "Flag", "strings": "String"}


def _any_typed(raw: Column, number: Column, kind: Column) -> tuple[Column, Column]:
    """:meth:`TargetField.typed` for a declaration that differs from row to row; scalars are lists of one."""
    scalar, values, good = number.isin("0", "1"), [], F.lit(False)
    for name, t in _KINDS.items():
        is_kind = ~kind.isin("Integer", "Float", "Flag") if t == "String" else kind == t
        one, one_good = TargetField("", "1", t).typed(raw)
        many, many_good = TargetField("", ".", t).typed(raw)
        value = one if t == "Flag" else F.when(scalar & one.isNotNull(), F.array(one)).when(~scalar, many)
        values.append(F.when(is_kind, value).alias(name))
        good = F.when(is_kind, F.when(scalar, one_good).otherwise(many_good)).otherwise(good)
    return F.struct(number.alias("number"), kind.alias("type"), *values), F.coalesce(good, F.lit(False))


def promote_all(table: DataFrame, names: DataFrame, fitted: str | None = None) -> DataFrame:
    """``table`` with every declared field that is rescued in one typed map, replayed from ``_rescued``.

    ``names`` is the result of :func:`canonical_fields`; ``table`` needs ``file_id``.  The map
    ``_promoted`` (null if it has no entry) leads from a field to ``number, type, integers, floats,
    flag, strings``, of which the one of its type is set: a list, of one value where ``number`` is 0
    or 1, or null for ``.``.  A value has the field's most frequent declaration if it fits, else that
    of its own file (of two fields of a file with one name, the one that had it already).  However
    many fields there are, the plan stays the same: entries meet their declarations in joins.

    ``fitted`` names the column of fields that :func:`ingest` has taken; it is dropped.  With it,
    values that did not fit a column are replayed too, without it only fields that are no column.

    Defined cases are those of :func:`promote`: values that fit no declaration, further values of a
    repeated key and undeclared fields stay rescued, in their order.
    """
    rows = stage(table.withColumn("__row", F.monotonically_increasing_id()), "rescued")
    own = [c for c in table.columns if c not in (RESCUED, PROMOTED, fitted)]
    target = maybe_broadcast(target_fields(names).select(F.col("canonical").alias("field"), "number", "type"))
    local = names.groupBy("file_id", F.col("canonical").alias("field")).agg(F.min(F.struct(F.col("canonical") != F.col("field_id"), "number", "type")).alias("m"))
    local = maybe_broadcast(local.select("file_id", "field", F.col("m.number").alias("own_number"), F.col("m.type").alias("own_type")))
    before = F.col(f"`{fitted}`") if fitted else F.array(*[F.lit(c) for c in own]).cast("array<string>")
    entries = rows.where(F.col(RESCUED).isNotNull()).select("__row", "file_id", before.alias("before"), F.posexplode(F.from_json(RESCUED, _ENTRY)).alias("at", "e"))
    entries = entries.select("__row", "file_id", "at", "e.field", "e.value", F.array_contains("before", F.col("e.field")).alias("is_before"))
    judged = entries.join(target, "field", "left").join(local, ["file_id", "field"], "left")
    typed, good = _any_typed(F.col("value"), F.col("number"), F.col("type"))
    own_typed, own_good = _any_typed(F.col("value"), F.col("own_number"), F.col("own_type"))
    judged = judged.select("__row", F.struct("at", "field", "value", (~F.col("is_before") & (good | own_good)).alias("good"), F.when(good, typed).otherwise(own_typed).alias("typed")).alias("e"))
    lists = judged.groupBy("__row").agg(F.array_sort(F.collect_list("e"), lambda a, b: a["at"] - b["at"]).alias("__all"))
    # as in _fit: the first entry of a field is taken if it fits
    taken = lambda e, i: e["good"] & ~F.exists(F.slice("__all", 1, i), lambda b: b["field"] == e["field"])
    lists = lists.select("__row", F.filter("__all", taken).alias("__taken"), F.filter("__all", lambda e, i: ~taken(e, i)).alias("__rest"))
    lists = lists.select(
        "__row",
        F.when(F.size("__taken") > 0, F.map_from_entries(F.transform("__taken", lambda e: F.struct(e["field"], e["typed"])))).alias(PROMOTED),
        F.when(F.size("__rest") > 0, F.to_json(F.transform("__rest", lambda e: F.struct(e["field"].alias("field"), e["value"].alias("value"))))).alias(RESCUED),
    )
    return rows.select("__row", *[F.col(f"`{c}`") for c in own]).join(lists, "__row", "left").select(*[F.col(f"`{c}`") for c in own], PROMOTED, RESCUED)


def report_counts(changes: DataFrame) -> Mapping[str, int]:
    """How often each kind of change occurs (five kinds, so the result is bounded)."""
    return {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
