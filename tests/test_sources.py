import gzip
import hashlib

import pytest
from pyspark.sql import types as T

from strandlake.sources.fasta import fa_info, read_fai, read_fasta
from strandlake.sources.plain import open_text
from strandlake.sources.vcf import iter_vcf, read_vcf, read_vcf_header
from strandlake.sources.vcf_header import VcfHeader, column_type, parse_header, parse_number, spark_to_vcf_type
from strandlake.sources.vcf_write import vcf_lines, write_vcf
from strandlake.streaming.annotate import hits_per_batch, stream_as_bool

from .conftest import rows

VCF = """##fileformat=VCFv4.3
##contig=<ID=chr1,length=1000,x=y>
##INFO=<ID=SVTYPE,Number=1,Type=String,Description="a, \\"b\\"">
##INFO=<ID=SVLEN,Number=A,Type=Integer,Description="l">
##INFO=<ID=AF,Number=A,Type=Float,Description="f">
##INFO=<ID=DB,Number=0,Type=Flag,Description="d">
##INFO=<ID=RR,Number=R,Type=Integer,Description="r">
##INFO=<ID=XX,Number=foo,Type=Bar,Description="x">
##FILTER=<ID=q1,Description="low">
##FORMAT=<ID=GT,Number=1,Type=String,Description="g">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="a">
##other=thing
#CHROM	POS	ID	REF	ALT	QUAL	FILTER	INFO	FORMAT	S1	S2
chr1	100	rs1	A	G,ACG	5.5	PASS	AF=0.1,0.2;DB;RR=1,2,3	GT:AD	0|1:3,4	./.:.
chr1	200	.	AcGT	A	.	q1;q2	XX=a,b;AF=no	GT	0/1
chr2	300	.	N	<DEL:ME>	.	.	SVLEN=-50;SVTYPE=INS
chr2	400	.	N	<INS>	.	.	SVTYPE=INS
chr2	500	.	N	N[chr1:5[,<INV>,<TRA>,<FOO>	.	.	END=600
chr2	600	.	AC	GT	.	PASS	.
chr2	700	.	A	.	.	PASS	.
"""


@pytest.fixture(params=["x.vcf", "x.vcf.GZ"])
def path(request, tmp_path):
    p = tmp_path / request.param.lower()
    (gzip.open if p.suffix == ".gz" else open)(p, "wt").write(VCF)
    return str(p)


def test_tables(spark, path):
    t = read_vcf(spark, path)
    snv = t.table("snv").first()
    assert (snv.chrom, snv.pos, snv.end, snv.id, snv.ref, snv.alt, snv["filter"], snv.vcf_pos, snv.vcf_id, snv.vcf_rec, snv.vcf_allele) == ("chr1", 99, 100, "chr1-100-SNV-AG", "A", "G", [], 100, "rs1", 0, 1)
    assert (snv.vcf_info_AF, snv.vcf_info_DB, snv.vcf_info_RR, snv.vcf_info_SVTYPE) == (0.1, True, [1, 2, 3], None)
    got = [(r.id, r.pos, r.end, r.varlen, r.seq, r["filter"], r.vcf_info_AF, r.vcf_info_XX) for r in t.table("insdel").collect()]
    assert got == [("chr1-101-INS-2", 100, 101, 2, "CG", [], 0.2, None), ("chr1-201-DEL-3", 200, 203, 3, "cGT", ["q1", "q2"], None, ["a", "b"]), ("chr2-300-DEL-50", 299, 349, 50, None, None, None, None)]
    assert [(r.id, r.end) for r in t.table("inv").collect()] == [("chr2-500-INV-101", 600)]
    assert [(r.varlen, r.ref, r.alt) for r in t.table("sub").collect()] == [(4, "AC", "GT")]
    assert sorted((r.vcf_rec, r.vcf_allele, r.vartype) for r in t.ignored.collect()) == [(3, 1, None), (4, 1, "BND"), (4, 3, "TRA"), (4, 4, None)]
    samples = {(r.vcf_rec, r.vcf_sample): (r.GT, r.AD) for r in t.samples.collect()}
    assert samples[0, "S1"] == ("0|1", [3, 4]) and samples[0, "S2"] == ("./.", None) and samples[1, "S1"] == ("0/1", None) and {k[0] for k in samples} == {0, 1, 2, 4, 5}
    with pytest.raises(ValueError):
        t.table("nope")


def test_regions_and_batches(spark, path, tmp_path):
    count = lambda *a: read_vcf(spark, path, *a).alleles.select("vcf_rec").distinct().count()
    assert (count("chr1"), count("chr1", 150, 250), count("chr1", 203), count("chr1", 202), count("chr1", 0, 99), count("chr3")) == (2, 1, 0, 1, 0, 0)
    assert len(list(iter_vcf(spark, path, batch_size=3))) == 2 and len(list(iter_vcf(spark, path, chrom="zz"))) == 1
    for bad in ({"start": 1}, {"end": 1}, {"chrom": "chr1", "start": 5, "end": 4}):
        with pytest.raises(ValueError):
            read_vcf(spark, path, **bad)
    with pytest.raises(FileNotFoundError):
        read_vcf(spark, str(tmp_path / "none.vcf"))
    with pytest.raises(ValueError):
        next(iter_vcf(spark, path, batch_size=0))


def test_header(path):
    h = read_vcf_header(path)
    assert h.vcf_version == "4.3" and h.file_date is None and h.samples == ["S1", "S2"] and h.meta == [("other", "thing")]
    assert h.lines["INFO"]["SVTYPE"].description == 'a, "b"' and not h.is_valid and len(h.validation_errors) == 2
    x = h.lines["INFO"]["XX"]
    assert (x.number, x.type, h.contigs[0].fields["length"], h.contigs[0].fields["x"]) == (".", "String", 1000, "y")
    assert str(parse_header(str(h).splitlines())) == str(h)


def test_header_changes():
    h = VcfHeader(file_date="20240101", reference="r.fa")
    h.add_contig("c", 5)
    h.add_info("A", " 2 ", "Float", "d", source="s")
    h.add_filter("q", 'say "x"')
    h.add_format("GT", 1, "String", "g")
    h.add_alt("DEL", "d")
    h.add_sample("s1")
    h.add_meta("k", "v")
    assert h.is_valid and '##FILTER=<ID=q,Description="say \\"x\\"">' in str(h) and str(h).endswith("FORMAT\ts1\n")
    with pytest.warns(UserWarning):
        h.add_info("B", -1, "Flagg", "d")
    for bad in (lambda: h.add_info("A", 1, "Float", "d"), lambda: h.add_sample("s1"), lambda: h.add_sample(""), lambda: h.add_info(" ", 1, "Float", "d"), lambda: h.add_meta("a b", "c"), lambda: VcfHeader(" ")):
        with pytest.raises(ValueError):
            bad()
    h.remove("INFO", "B")
    h.remove_sample("s1")
    h.remove_meta("k")
    assert h.is_valid and "FORMAT\t" not in str(h)


def test_types():
    assert [parse_number(x) for x in (3, " 01 ", "A", ".")] == [3, 1, "A", "."]
    for bad in (-1, "-1", "1.0", "a", "", True):
        with pytest.raises(ValueError):
            parse_number(bad)
    assert column_type(1, "Integer") == T.LongType() == column_type("A", "Integer") and column_type("R", "Float") == T.ArrayType(T.DoubleType()) and column_type(0, "Flag") == T.BooleanType()
    assert [spark_to_vcf_type(t) for t in (T.IntegerType(), T.FloatType(), T.BooleanType(), T.StringType())] == ["Integer", "Float", "Flag", "String"]
    with pytest.raises(TypeError):
        spark_to_vcf_type(T.DateType())


@pytest.mark.parametrize("form", ["seq", "symbolic"])
def test_writing(spark, path, tmp_path, form):
    t = read_vcf(spark, path)
    both = t.table("snv").unionByName(t.table("insdel"), allowMissingColumns=True)
    out = str(tmp_path / "out")
    write_vcf(both, out, alt_format=form, sample_name="S")
    again = read_vcf(spark, out)
    cut = ["chrom", "pos", "end", "id", "varlen", *(["vcf_allele"] if form == "seq" else [])]
    assert rows(again.table("insdel").select(*cut)) == rows(t.table("insdel").select(*cut))
    assert again.header.samples == ["S"] and again.table("snv").first().id == "chr1-100-SNV-AG"
    assert vcf_lines(both, form).count() == (3 if form == "seq" else 4) and vcf_lines(both.limit(0), form).count() == 0
    with pytest.raises(ValueError):
        vcf_lines(both.drop("vcf_rec"), form)


def test_fasta_records_begin_at_line_starts_only(spark, tmp_path):
    fa = tmp_path / "y.fa"
    fa.write_bytes(b">chr1 from a>b note\r\nAC>GT\r\nAA\r\n>b\r\nTT\r\n\r\n>c\n")
    assert [tuple(r) for r in read_fasta(spark, str(fa)).orderBy("order").collect()] == [("chr1", 0, "AC>GTAA"), ("b", 1, "TT"), ("c", 2, "")]
    fa.write_bytes(b"")
    assert read_fasta(spark, str(fa)).collect() == []


def test_fasta(spark, tmp_path):
    fa = tmp_path / "x.fa"
    fa.write_text(">c1 text\nACgt\nAC\n>c2\nTT\n>c0\n")
    (tmp_path / "x.fa.fai").write_text("c1\t6\t9\t4\t5\nc2\t2\t20\t2\t3\nzz\t1\t1\t1\t1\n")
    assert [tuple(r) for r in read_fasta(spark, str(fa)).orderBy("order").collect()] == [("c1", 0, "ACgtAC"), ("c2", 1, "TT"), ("c0", 2, "")]
    got = {r.chrom: (r.len, r.md5, r.order) for r in fa_info(spark, str(fa)).collect()}
    assert got == {"c1": (6, hashlib.md5(b"ACGTAC").hexdigest(), 0), "c2": (2, hashlib.md5(b"TT").hexdigest(), 1), "zz": (1, None, None)}
    assert read_fai(spark, str(fa) + ".fai", name="qry_id").columns == ["qry_id", "len"] and len(read_fai(spark, str(fa) + ".fai", None).columns) == 5
    with pytest.raises(ValueError):
        read_fai(spark, str(fa) + ".fai", ["nope"])


def test_plain_or_gzip(tmp_path):
    for name in ("a.txt", "b.GZ"):
        with open_text(tmp_path / name, "w") as f:
            f.write("é\n")
        assert open_text(tmp_path / name).read() == "é\n"
    assert gzip.open(tmp_path / "b.GZ").read() and open_text(tmp_path / "b.GZ", gz=True).read()
    with pytest.raises(ValueError):
        open_text(tmp_path / "a.txt", "a")


def test_stream(spark, tmp_path):
    schema = "_index long, chrom string, pos long, `end` long"
    spark.createDataFrame([(0, "c", 5, 50_000), (1, "c", 90_000, 90_001), (2, "d", 1, 2), (3, "c", None, 3)], schema).write.parquet(str(tmp_path / "in"))
    table = spark.createDataFrame([("c", 49_990, 49_995), ("c", 40_000, 40_001), ("c", 90_003, 90_004)], "chrom string, pos long, `end` long")
    for d, want in ((0, [True, False, False, False]), (2, [True, True, False, False])):
        hits = stream_as_bool(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), table, "hit", d)
        out = str(tmp_path / f"out{d}")
        hits.writeStream.foreachBatch(lambda b, _, out=out: hits_per_batch(b, "hit").write.mode("append").parquet(out)).option("checkpointLocation", out + "s").trigger(availableNow=True).start().awaitTermination()
        assert [r.hit for r in spark.read.parquet(out).orderBy("_index").collect()] == want


def test_unreadable_positions_are_ignored_with_the_reason(spark, tmp_path):
    p = tmp_path / "bad.vcf"
    p.write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nc\tx1\t.\tA\tG\t.\t.\t.\nc\t7\t.\tA\tG\t.\t.\t.\n")
    t = read_vcf(spark, str(p))
    assert [(r.vcf_rec, r.vcf_pos, r.vcf_ignored) for r in t.ignored.collect()] == [(0, None, "unreadable position 'x1'")]
    assert [r.pos for r in t.table("snv").collect()] == [6] and read_vcf(spark, str(p), "c", 0, 100).alleles.count() == 1


def test_reference_bases_of_moved_records(spark, tmp_path):
    fa = tmp_path / "r.fa"
    fa.write_text(">c\nACGTAC\nGTTTGA\n>d\nGG\n")
    data = [("c", 5, "N", "NAC", 0, 1, "INS", 2, "AC", 5), ("c", 9, "A", "G", 1, 1, "SNV", 1, None, 8), ("d", 9, "N", "NT", 2, 1, "INS", 1, "T", 9)]
    df = spark.createDataFrame(data, "chrom string, vcf_pos long, vcf_ref string, vcf_alt string, vcf_rec long, vcf_allele int, vartype string, varlen long, seq string, pos long")
    out = str(tmp_path / "w")
    write_vcf(df, out, alt_format="symbolic", ref_fasta=str(fa))
    got = sorted(tuple(r.value.split("\t")[i] for i in (0, 1, 3, 4)) for r in spark.read.option("recursiveFileLookup", "true").text(out).where("value not like '#%'").collect())
    assert got == [("c", "6", "C", "<INS>"), ("c", "9", "A", "G"), ("d", "10", "N", "<INS>")]
