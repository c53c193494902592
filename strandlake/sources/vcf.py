"""VCF as tables: one typed table per variant type, one of the alleles left out, one of the samples.

The header is read on the driver, since it gives the columns; the body is a distributed text scan, and
alleles are classified in the JVM.  Coordinates are 0-based half-open; ``vcf_pos`` is the file's POS.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions.alleles import KEPT_IGNORED, TABLE_OF, sequence_allele, symbolic_allele
from strandlake.functions.variants import sort_columns, variant_id
from strandlake.operators.indexing import numbered, with_index
from strandlake.schema import STANDARD_FIELDS
from strandlake.session import stage
from strandlake.sources.plain import open_text
from strandlake.sources.vcf_header import VcfHeader, parse_header

# What every allele keeps of its record.
VCF_COLUMNS = ("vcf_pos", "vcf_id", "vcf_ref", "vcf_alt", "vcf_qual", "vcf_rec", "vcf_allele")
_RESERVED_FORMAT = {"vcf_rec", "vcf_sample"}


def read_vcf_header(path: str | os.PathLike, warn_invalid: bool = False) -> VcfHeader:
    """The header of a ``.vcf`` or ``.vcf.gz`` file, or of a folder as ``write_vcf`` makes it."""
    lines = []
    if os.path.isdir(path):
        path = min(os.path.join(at, f) for at, _, files in os.walk(path) for f in files if f.startswith("part-") and os.path.getsize(os.path.join(at, f)))
    with open_text(path) as f:
        for line in f:
            if not line.startswith("#"):
                break
            lines.append(line)
            if line.startswith("#CHROM"):
                break
    return parse_header(lines, warn_invalid)


def _text(value: Column) -> Column:
    """A field, or null for ``.`` and nothing."""
    return F.when((value != ".") & (value != ""), value)


def filter_list(raw: Column) -> Column:
    """Null for ``.``; empty for PASS; else the names."""
    names = F.filter(F.split(raw, ";"), lambda f: ~f.isin(".", "PASS", ""))
    return F.when(_text(raw).isNotNull(), names)


def _typed(raw: Column, want: T.DataType, allele: Column | None = None, flag: Column | None = None) -> Column:
    """A raw value as its column: a list, one value, the allele's value, or a flag."""
    if isinstance(want, T.BooleanType):
        return flag if flag is not None else raw.isNotNull()
    if isinstance(want, T.ArrayType):
        return F.transform(F.split(_text(raw), ","), lambda x: _text(x).try_cast(want.elementType))
    one = F.get(F.split(_text(raw), ","), allele - 1 if allele is not None else F.lit(0))
    return _text(one).try_cast(want)


@dataclass(frozen=True)
class VcfTables:
    """The tables of a file: ``alleles`` (all, tagged), ``snv insdel inv dup sub cpx``, ``ignored``, ``samples``."""

    header: VcfHeader
    alleles: DataFrame
    samples: DataFrame

    def table(self, name: str, sort: bool = True) -> DataFrame:
        """The table of a variant type: its standard columns, the record's, and ``vcf_info_*``."""
        if name == "ignored":
            return self.ignored
        if name not in STANDARD_FIELDS:
            raise ValueError(f"unknown table {name!r}; known: {', '.join(STANDARD_FIELDS)}, ignored")
        info = [c for c in self.alleles.columns if c.startswith("vcf_info_")]
        rows = self.alleles.where(F.col("_table") == name)
        rows = rows.withColumn("id", variant_id())
        columns = [*STANDARD_FIELDS[name], *VCF_COLUMNS, *info]
        return (rows.orderBy(*sort_columns(rows.columns)) if sort else rows).select(*columns)

    @property
    def ignored(self) -> DataFrame:
        rows = self.alleles.where("_table = 'ignored'")
        kept = F.when(F.col("vartype").isin(*KEPT_IGNORED), F.col("vartype"))
        return rows.select("chrom", "filter", kept.alias("vartype"), "vcf_ignored", *VCF_COLUMNS)

    def batches(self, batch_size: int = 10_000) -> Iterator[dict[str, DataFrame]]:
        """The tables of successive groups of ``batch_size`` records; at least one batch, maybe empty.

        Only records that come out are counted, so those that a region leaves out fill no batch.  The
        alleles are read and stored once, in the order of their batches, and every batch reads its part.
        """
        if batch_size < 1:
            raise ValueError("a batch has a record at least")
        alleles = stage(self.alleles, "alleles")
        records, n = numbered(alleles.select("vcf_rec").distinct(), ["vcf_rec"], "__n")
        records = records.select("vcf_rec", F.floor(F.col("__n") / F.lit(batch_size)).alias("__batch"))
        by_batch = lambda df: stage(df.join(records, "vcf_rec").repartitionByRange("__batch", "vcf_rec").sortWithinPartitions("__batch", "vcf_rec"), "batches")
        alleles, samples = by_batch(alleles), by_batch(self.samples)
        for k in range(max(1, -(-n // batch_size))):
            own = F.col("__batch") == k
            part = VcfTables(self.header, alleles.where(own).drop("__batch"), samples.where(own).drop("__batch"))
            yield {x: part.table(x) for x in (*STANDARD_FIELDS, "ignored")} | {"samples": part.samples}


def read_vcf(spark: SparkSession, path: str | os.PathLike, chrom: str | None = None, start: int | None = None, end: int | None = None) -> VcfTables:
    """The tables of a VCF file (or a folder of its parts), optionally of the records that touch a region (0-based half-open).

    ``start`` and ``end`` need ``chrom``, and start <= end.  A missing file is a FileNotFoundError.
    Alleles with brackets, of unknown type, insertions without a length and records whose POS is no
    number are in ``ignored`` with the reason (these are in no region).  Lines of fewer than 8 fields are skipped.  Values that are not of their declared
    type are null.  BCF and tabix indexes are not read.
    """
    path = os.fspath(path).removeprefix("file://")
    remote = "://" in path
    if not remote and not os.path.exists(path):
        raise FileNotFoundError(path)
    if chrom is None and (start is not None or end is not None):
        raise ValueError("start and end need a chromosome")
    if start is not None and end is not None and start > end:
        raise ValueError("start is after end")
    text = spark.read.option("recursiveFileLookup", "true").text(path)
    # a header is small; of a remote file it is found by a scan
    header = parse_header([r.value for r in text.where(F.col("value").startswith("#")).collect()]) if remote else read_vcf_header(path)
    clash = _RESERVED_FORMAT & {f.id for f in header.formats}
    if clash:
        raise ValueError(f"FORMAT fields of reserved names: {sorted(clash)}")
    lines = text.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    f = F.split("value", "\t")
    # lines stand in the same places of the same files each time they are read, so they are only counted first
    records = with_index(lines, name="vcf_rec", store=False).select("vcf_rec", f.alias("f")).where(F.size("f") >= 8)
    at = lambda i: F.get("f", F.lit(i))
    keys = F.transform(F.split(at(7), ";"), lambda x: F.substring_index(x, "=", 1))
    values = F.transform(F.split(at(7), ";"), lambda x: F.when(x.contains("="), F.regexp_replace(x, r"\A[^=]*=", "")))
    records = records.select(
        "vcf_rec",
        at(0).alias("chrom"),
        at(1).try_cast("long").alias("vcf_pos"),
        at(1).alias("raw_pos"),
        _text(at(2)).alias("vcf_id"),
        at(3).alias("vcf_ref"),
        F.split(at(4), ",").alias("alts"),
        _text(at(5)).try_cast("float").alias("vcf_qual"),
        filter_list(at(6)).alias("filter"),
        keys.alias("keys"),
        values.alias("values"),
        F.split(F.coalesce(at(8), F.lit("")), ":").alias("format"),
        F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0))).alias("calls"),
    )
    if chrom is not None:
        records = records.where(F.col("chrom") == chrom)
        if end is not None:
            records = records.where(F.col("vcf_pos") - 1 < end)
        if start is not None:
            records = records.where(F.col("vcf_pos") - 1 + F.length("vcf_ref") > start)

    def info(name: str) -> Column:
        return F.get("values", F.array_position("keys", F.lit(name)).cast("int") - 1)

    def of_allele(name: str) -> Column:
        """The allele's own value if there is one per allele, else the first."""
        told = F.split(info(name), ",")
        return _text(F.get(told, F.when(F.size(told) == F.size("alts"), F.col("k")).otherwise(F.lit(0))))

    alleles = records.select("*", F.posexplode("alts").alias("k", "vcf_alt")).where("vcf_alt <> '.'").withColumn("vcf_allele", F.col("k") + 1)
    pos0, alt = F.col("vcf_pos") - 1, F.col("vcf_alt")
    symbolic = symbolic_allele(pos0, alt, of_allele("SVTYPE"), of_allele("SVLEN").try_cast("long"), of_allele("END").try_cast("long"), of_allele("SEQ"))
    alleles = alleles.withColumn("s", F.when(alt.startswith("<"), symbolic)).withColumn("q", F.when(~alt.startswith("<"), sequence_allele(pos0, F.col("vcf_ref"), alt)))
    for name in ("vartype", "varlen", "ref", "alt", "seq", "pos", "end"):
        alleles = alleles.withColumn(name, F.coalesce(F.col(f"s.{name}"), F.col(f"q.{name}")))
    breakend = alt.contains("[") | alt.contains("]")
    known = F.col("vartype").isin(*TABLE_OF)
    reason = (
        F.when(F.col("vcf_pos").isNull(), F.concat(F.lit("unreadable position '"), F.col("raw_pos"), F.lit("'")))
        .when(breakend, "BND breakend allele")
        .when(F.col("s.error").isNotNull(), F.col("s.error"))
        .when(~known & F.col("vartype").isin(*KEPT_IGNORED), F.concat("vartype", F.lit(" structural variant")))
        .when(~known, F.concat(F.lit("unrecognized variant type '"), "vartype", F.lit("'")))
    )
    alleles = alleles.withColumn("vcf_ignored", reason).withColumn("vartype", F.when(breakend, "BND").when(F.col("s.error").isNotNull(), None).otherwise(F.col("vartype")))
    table = F.element_at(F.create_map(*[F.lit(x) for kv in TABLE_OF.items() for x in kv]), F.col("vartype"))
    alleles = alleles.withColumn("_table", F.when(F.col("vcf_ignored").isNotNull(), F.lit("ignored")).otherwise(table))
    for line in header.info:
        own = F.col("vcf_allele") if line.number == "A" else None
        there = F.array_contains("keys", F.lit(line.id))
        alleles = alleles.withColumn(f"vcf_info_{line.id}", _typed(info(line.id), line.spark_type(), own, F.when(there, True)))
    columns = ["_table", "chrom", "pos", "end", "vartype", "varlen", "ref", "alt", "filter", "seq", "vcf_ignored", *VCF_COLUMNS, *[f"vcf_info_{x.id}" for x in header.info]]

    emitted = alleles.where("_table <> 'ignored'").select("vcf_rec").distinct()
    names = F.array(*[F.lit(s) for s in header.samples]) if header.samples else F.array().cast("array<string>")
    calls = records.join(emitted, "vcf_rec", "left_semi").select("vcf_rec", "format", F.explode(F.arrays_zip(names.alias("n"), F.col("calls").alias("c"))).alias("x")).where("x.n is not null")
    cells = F.split("x.c", ":")

    def call(line) -> Column:
        raw = F.get(cells, F.array_position("format", F.lit(line.id)).cast("int") - 1)
        if line.id == "GT":  # kept as text: alleles, phased or not, with dots where unknown
            return raw
        return _typed(raw, line.spark_type())

    samples = calls.select("vcf_rec", F.col("x.n").alias("vcf_sample"), *[call(x).alias(x.id) for x in header.formats])
    return VcfTables(header, alleles.select(*columns), samples)


def iter_vcf(spark: SparkSession, path: str | os.PathLike, *, batch_size: int = 10_000, chrom: str | None = None, start: int | None = None, end: int | None = None) -> Iterator[dict[str, DataFrame]]:
    """:func:`read_vcf` in batches of records."""
    return read_vcf(spark, path, chrom, start, end).batches(batch_size)
