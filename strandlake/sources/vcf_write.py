"""Writing variant tables as VCF 4.2 text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.schema import check_columns
from strandlake.sources.fasta import read_fasta
from strandlake.sources.vcf_header import SOURCE, VcfHeader, spark_to_vcf_type

_PREFIX = "vcf_info_"
_SYMBOLIC = ("INS", "DEL", "INV", "DUP")


def build_header(df: DataFrame, sample_name: str | None = None, source: str = SOURCE, alt_format: str = "seq") -> VcfHeader:
    """A header whose INFO lines come from the ``vcf_info_*`` columns and their types."""
    header = VcfHeader(source=source, warn_invalid=False)
    for f in df.schema.fields:
        if f.name.startswith(_PREFIX):
            listed = isinstance(f.dataType, T.ArrayType)
            kind = spark_to_vcf_type(f.dataType.elementType if listed else f.dataType)
            header.add_info(f.name.removeprefix(_PREFIX), "." if listed else 0 if kind == "Flag" else 1, kind, "Taken from the table")
    if alt_format == "symbolic":
        for name, number, kind, text in (("SVTYPE", 1, "String", "Type of the variant"), ("SVLEN", "A", "Integer", "Length of the variant"), ("SEQ", "A", "String", "Sequence of the variant")):
            if name not in header.lines["INFO"]:
                header.add_info(name, number, kind, text)
    if sample_name:
        header.add_format("GT", 1, "String", "Genotype")
        header.add_sample(sample_name)
    return header


def _field(value: Column, empty: str = ".") -> Column:
    return F.coalesce(value.cast("string"), F.lit(empty))


def vcf_lines(df: DataFrame, alt_format: str = "seq", sample_name: str | None = None) -> DataFrame:
    """``chrom, vcf_pos, vcf_rec, line``: one record per ``vcf_rec``, its alleles in order of ``vcf_allele``.

    A record's alleles are one group; their number is that of a file's ALT field.  INFO values are
    those of the first allele.  ``symbolic`` writes structural alleles as ``<TYPE>`` with their
    sequence in INFO/SEQ, each as a record of its own at ``pos`` + 1 (where the table has ``pos``),
    so that reading gives its coordinates again.  A null filter is ``.``, an empty one PASS.
    """
    if alt_format not in ("seq", "symbolic"):
        raise ValueError(f"alt_format {alt_format!r} is not 'seq' or 'symbolic'")
    needed = {"chrom", "vcf_pos", "vcf_ref", "vcf_alt", "vcf_rec", "vcf_allele"} | ({"vartype"} if alt_format == "symbolic" else set())
    check_columns(df, needed)
    have = set(df.columns)
    get = lambda c, t="string": F.col(c) if c in have else F.lit(None).cast(t)
    alt, own_record = F.col("vcf_alt"), F.lit(0)
    if alt_format == "symbolic":
        structural = F.col("vartype").isin(*_SYMBOLIC)
        alt = F.when(structural, F.concat(F.lit("<"), F.col("vartype"), F.lit(">"))).otherwise(alt)
        own_record = F.when(structural, F.col("vcf_allele")).otherwise(0)
        if "pos" in have:
            moved = structural & (F.col("pos") + 1 != F.col("vcf_pos"))
            df = df.withColumns({"vcf_ref": F.when(moved, "N").when(structural, F.left("vcf_ref", F.lit(1))).otherwise(F.col("vcf_ref")), "vcf_pos": F.when(moved, F.col("pos") + 1).otherwise(F.col("vcf_pos"))})
    infos = []
    for f in df.schema.fields:
        if f.name.startswith(_PREFIX):
            name, c = f.name.removeprefix(_PREFIX), F.col(f"`{f.name}`")
            if alt_format == "symbolic" and name in ("SVTYPE", "SVLEN", "SEQ"):
                continue
            if isinstance(f.dataType, T.BooleanType):
                infos.append(F.when(c, F.lit(name)))
            else:
                value = F.array_join(F.transform(c, lambda x: x.cast("string")), ",", ".") if isinstance(f.dataType, T.ArrayType) else c.cast("string")
                infos.append(F.concat(F.lit(f"{name}="), value))
    listed = F.array_sort(F.collect_list(F.struct(F.col("vcf_allele").alias("o"), alt.alias("alt"), get("vartype").alias("t"), get("varlen", "long").alias("n"), get("seq").alias("s"))))
    info = F.array_join(F.array_compact(F.array(*infos)), ";") if infos else F.lit("")
    first = F.struct("vcf_allele", get("vcf_id").alias("id"), F.col("vcf_ref").alias("ref"), get("vcf_qual", "float").alias("qual"), get("filter", "array<string>").alias("filter"), info.alias("info"))
    rows = df.groupBy("chrom", "vcf_pos", "vcf_rec", own_record.alias("own")).agg(listed.alias("a"), F.min_by(first, F.col("vcf_allele")).alias("r"))
    alts = F.array_join(F.transform("a", lambda x: x["alt"]), ",")
    passed = F.when(F.col("r.filter").isNull(), ".").when(F.size("r.filter") == 0, "PASS").otherwise(F.array_join("r.filter", ";"))
    info = F.col("r.info")
    if alt_format == "symbolic":
        own = lambda what: F.array_join(F.transform("a", lambda x: x[what].cast("string")), ",", ".")
        info = F.array_join(F.array_compact(F.array(F.concat(F.lit("SVTYPE="), F.get("a", F.lit(0))["t"]), F.concat(F.lit("SVLEN="), own("n")), F.concat(F.lit("SEQ="), own("s")), F.when(info != "", info))), ";")
    parts = [F.col("chrom"), F.col("vcf_pos").cast("string"), _field(F.col("r.id")), F.col("r.ref"), alts, _field(F.col("r.qual")), passed, F.when(info == "", ".").otherwise(info)]
    if sample_name:
        parts += [F.lit("GT"), F.lit("./.")]
    return rows.select("chrom", "vcf_pos", "vcf_rec", F.concat_ws("\t", *parts).alias("line"))


def with_reference_bases(lines: DataFrame, ref_fasta: str, chunk: int = 1 << 16) -> DataFrame:
    """``lines`` of :func:`vcf_lines` with the reference's base where REF is ``N``.

    The reference is cut into chunks, and a line meets the chunk of its position, so neither a whole
    chromosome nor all lines of one come together.  Positions outside of the reference keep ``N``.
    """
    chunks = read_fasta(lines.sparkSession, ref_fasta).select(F.col("chrom").alias("__c"), F.posexplode(F.regexp_extract_all("seq", F.lit(f"(.{{1,{chunk}}})"), F.lit(1))).alias("__k", "__text"))
    at = lines.withColumn("__p", F.col("vcf_pos") - 1).withColumn("__k", F.floor(F.col("__p") / F.lit(chunk)).cast("int"))
    open_ref = F.split("line", "\t")[3] == "N"
    met = at.where(open_ref).join(chunks.withColumnRenamed("__c", "chrom"), ["chrom", "__k"], "left")
    base = F.upper(F.substring("__text", (F.col("__p") - F.col("__k").cast("long") * chunk + 1).cast("int"), F.lit(1)))
    known = F.when(F.coalesce(base, F.lit("")) != "", F.regexp_replace(F.col("line"), F.lit("\\A((?:[^\t]*\t){3})N"), F.concat(F.lit("$1"), base)))
    columns = ["chrom", "vcf_pos", "vcf_rec"]
    return met.select(*columns, F.coalesce(known, "line").alias("line")).unionByName(at.where(~open_ref).select(*columns, "line"))


def write_vcf(df: DataFrame, path: str, *, alt_format: str = "seq", sample_name: str | None = None, source: str = SOURCE, ref_fasta: str | None = None) -> None:
    """Writes a folder of VCF text parts, sorted by chromosome and position; part 0 is the header.

    The parts in the order of their names are one valid file, so no task ever holds all records.
    With ``ref_fasta`` a REF that is not known from the table is read from that file.
    """
    header = build_header(df, sample_name, source, alt_format)
    spark = df.sparkSession
    lines = vcf_lines(df, alt_format, sample_name)
    if ref_fasta is not None:
        lines = with_reference_bases(lines, ref_fasta)
    lines = lines.repartitionByRange("chrom", "vcf_pos", "vcf_rec").sortWithinPartitions("chrom", "vcf_pos", "vcf_rec").select(F.col("line").alias("value"))
    spark.createDataFrame([(str(header).rstrip("\n"),)], "value string").coalesce(1).write.text(f"{path}/part=00000-header")
    lines.write.text(f"{path}/part=00001-records")
