"""Queries (and their DuckDB SQL) of variant, allele, k-mer and alignment functions, and of the file sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import kmer as K
from strandlake.functions.alleles import sequence_allele, symbolic_allele
from strandlake.functions.score import AffineScoreModel, cigar_expr
from strandlake.functions.similarity import edit_distance_column
from strandlake.functions.variants import lead_source, sort_columns, variant_id, version_ids
from strandlake.operators.dotplot import match_lines, match_points
from strandlake.operators.indexing import with_index
from strandlake.operators.overlap import Extra, PairwiseOverlap
from strandlake.schema import STANDARD_FIELDS, to_variant
from strandlake.session import new_path
from strandlake.sources.fasta import fa_info
from strandlake.sources.vcf import read_vcf
from strandlake.sources.vcf_write import write_vcf


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/variant_calls.parquet")


def variant_ids(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d).select("call_id", variant_id().alias("id"))


def variant_sort(spark: SparkSession, d: str) -> DataFrame:
    calls = _calls(spark, d)
    return with_index(calls, [*sort_columns(calls.columns), F.col("call_id")], "place").select("call_id", "place")


def variant_cast(spark: SparkSession, d: str) -> DataFrame:
    sub = to_variant(_calls(spark, d).withColumn("pos", F.col("pos").cast("int")))
    return sub.select("call_id", *STANDARD_FIELDS["sub"]).withColumn("filter", F.size("filter"))


def id_version(spark: SparkSession, d: str) -> DataFrame:
    return version_ids(_calls(spark, d), tie=["call_id"]).select("call_id", "id")


def lead_src(spark: SparkSession, d: str) -> DataFrame:
    merged = spark.read.parquet(f"{d}/merged_callset.parquet")
    return merged.select("mg_index", lead_source()).select("mg_index", "lead_src.src_name", "lead_src.var_index")


def kmer_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = K.explode_kmers(_calls(spark, d).select("seq"), "seq", 9)
    return rows.groupBy(K.kmer_code(F.col("kmer")).alias("kmer")).agg(F.count(F.lit(1)).alias("n"), F.sum("kmer_pos").alias("places"))


def kmer_canonical(spark: SparkSession, d: str) -> DataFrame:
    rows = K.explode_kmers(_calls(spark, d).select("seq"), "seq", 9)
    return rows.groupBy(K.canonical(F.col("kmer")).alias("kmer")).agg(F.count(F.lit(1)).alias("n"))


def kmer_minimizer(spark: SparkSession, d: str) -> DataFrame:
    rows = K.explode_kmers(_calls(spark, d).select("seq"), "seq", 9)
    return rows.groupBy(K.minimizer(F.col("kmer"), 5).alias("minimizer")).agg(F.count(F.lit(1)).alias("n"))


def kmer_jaccard(spark: SparkSession, d: str) -> DataFrame:
    pairs = _calls(spark, d).where("seq is not null").select("call_id", F.upper("seq").alias("a"), F.concat(F.substring(F.upper("seq"), F.lit(5), F.length("seq")), F.lit("ACGTACGTACGT")).alias("b"))
    return K.kmer_jaccard_pairs(pairs, "call_id", "a", "b", 9)


def _dots(spark: SparkSession, d: str) -> DataFrame:
    calls = _calls(spark, d).select("call_id", "seq")
    return match_points(calls.withColumn("other", K.reverse_complement(F.col("seq"))), "seq", "other", 11, ("call_id",))


def dotplot_points(spark: SparkSession, d: str) -> DataFrame:
    return _dots(spark, d).groupBy("call_id", "strand").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))


def dotplot_lines(spark: SparkSession, d: str) -> DataFrame:
    return match_lines(_dots(spark, d), 11, ("call_id",))


def _cigars(spark: SparkSession, d: str) -> DataFrame:
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    n = lambda c, m: (F.col(c) % m + 1).cast("long").cast("string")
    text = F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit("="), n("l_suppkey", 40), F.lit("I"), n("l_partkey", 9), F.lit("X"), n("l_orderkey", 60), F.lit("D"), n("l_partkey", 50), F.lit("="), F.lit("5S"))
    return line.select("l_orderkey", "l_linenumber", text.alias("cigar"))


def cigar_parse(spark: SparkSession, d: str) -> DataFrame:
    ops = _cigars(spark, d).select(F.explode(cigar_expr(F.col("cigar"))).alias("o"))
    return ops.groupBy(F.col("o.op").cast("int").alias("op")).agg(F.count(F.lit(1)).alias("n"), F.sum("o.len").alias("bases"))


def affine_score(spark: SparkSession, d: str) -> DataFrame:
    return _cigars(spark, d).select("cigar", AffineScoreModel().score_expr(cigar_expr(F.col("cigar"))).alias("score"))


def vcf_alleles(spark: SparkSession, d: str) -> DataFrame:
    """Alleles made of the calls' sequences: an insertion, a deletion or a replacement behind a common start."""
    calls = _calls(spark, d).where("seq is not null")
    head, n = F.substring("seq", 1, 3), F.col("call_id") % 3
    ref = F.when(n == 0, head).when(n == 1, F.col("seq")).otherwise(F.concat(head, F.lit("ac"), F.substring("seq", F.lit(4), F.length("seq"))))
    alt = F.when(n == 0, F.col("seq")).when(n == 1, head).otherwise(F.concat(F.lower(head), F.lit("G"), F.substring("seq", F.lit(4), F.length("seq"))))
    return calls.select("call_id", sequence_allele(F.col("pos"), ref, alt).alias("x")).select("call_id", "x.*")


def vcf_symbolic(spark: SparkSession, d: str) -> DataFrame:
    calls = _calls(spark, d)
    n = F.col("call_id") % 4
    x = symbolic_allele(F.col("pos"), F.concat(F.lit("<"), F.lower("vartype"), F.lit(":X>")), F.lit("UNK"), F.when(n == 0, -F.col("varlen")), F.when(n == 1, F.col("end")), F.when(n == 2, F.col("seq")))
    return calls.select("call_id", x.alias("x")).select("call_id", "x.vartype", "x.varlen", "x.pos", "x.end", F.col("x.error").isNotNull().alias("failed"))


def vcf_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Single-base calls written as VCF text and read back."""
    base = "upper(regexp_replace({}, '[^A-Za-z]', ''))"
    calls = _calls(spark, d).where("vartype = 'SNV' and chrom is not null").selectExpr("call_id", "chrom", "pos + 1 as vcf_pos", f"{base.format('ref')} as vcf_ref", f"{base.format('alt')} as vcf_alt", "filter", "varlen as vcf_info_LEN")
    calls = calls.where("length(vcf_ref) = 1 and length(vcf_alt) = 1 and vcf_ref <> vcf_alt").withColumns({"vcf_rec": F.col("call_id"), "vcf_allele": F.lit(1), "vcf_info_CALL": F.col("call_id")})
    path = new_path(spark, "vcf")
    write_vcf(calls, path)
    read = read_vcf(spark, path).table("snv", sort=False)
    return read.select(F.col("vcf_info_CALL").alias("call_id"), "chrom", "pos", "end", "ref", "alt", F.size("filter").alias("n_filter"), F.col("vcf_info_LEN").alias("varlen"))


_VCF_HEAD = """##fileformat=VCFv4.2
##INFO=<ID=KEY,Number=1,Type=Integer,Description="Order">
##INFO=<ID=AF,Number=A,Type=Float,Description="Share">
##INFO=<ID=LST,Number=.,Type=Integer,Description="List">
##INFO=<ID=FLG,Number=0,Type=Flag,Description="Flag">
##INFO=<ID=SVLEN,Number=A,Type=Integer,Description="Length">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2"""


def _orders_vcf(spark: SparkSession, d: str) -> str:
    """Every order as a VCF record, of a kind by its key: SNV, INS, DEL, three alleles, symbolic, ignored."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    key, n = F.col("o_orderkey"), F.col("o_orderkey") % 6
    by_kind = lambda *texts: reduce(lambda c, x: c.when(n == x[0], x[1]), list(enumerate(texts))[1:], F.when(n == 0, texts[0]))
    size = (F.col("o_custkey") % 90 + 1).cast("string")
    info = F.concat(F.lit("KEY="), key.cast("string"), by_kind(F.lit(";AF=0.5"), F.lit(";FLG"), F.lit(";LST=1,.,3"), F.lit(";AF=0.1,0.2,0.3"), F.concat(F.lit(";SVLEN=-"), size), F.lit(";AF=x")))
    line = F.concat_ws(
        "\t", F.concat(F.lit("c"), (F.col("o_custkey") % 25).cast("string")), (F.col("o_custkey") % 1000 + 100).cast("string"), F.lit("."),
        by_kind(*map(F.lit, ("A", "a", "ACGTT", "AC", "N", "N"))), by_kind(*map(F.lit, ("G", "ACGT", "A", "AG,ACTT,A", "<DEL:ME>", "N[c1:5[,<INS>"))),
        F.lit("."), by_kind(*map(F.lit, ("PASS", ".", "q1;q2", "PASS", "q1", "."))), info, F.lit("GT:DP"),
        F.concat(F.lit("0|1:"), (F.col("o_custkey") % 7).cast("string")), by_kind(*map(F.lit, ("./.", "0/0:.", "1/1:5", "0/0", ".", "0/0")))
    )
    path = new_path(spark, "orders-vcf")
    spark.createDataFrame([(_VCF_HEAD,)], "value string").coalesce(1).write.text(f"{path}/part=0")
    o.select(line.alias("value")).write.text(f"{path}/part=1")
    return path


def _allele_rows(alleles: DataFrame) -> DataFrame:
    # an allele left out keeps its record's fields, not coordinates
    own = [F.when(F.col("vcf_ignored").isNull(), F.col(c)).alias(c) for c in ("pos", "end", "varlen", "ref", "alt", "seq")]
    return alleles.select(
        F.col("vcf_info_KEY").alias("key"), "vcf_allele", F.col("_table").alias("kept_in"), "chrom", "vartype", *own,
        F.array_join("filter", ";").alias("filters"), F.round(F.col("vcf_info_AF").cast("double"), 4).alias("af"), F.coalesce("vcf_info_FLG", F.lit(False)).alias("flg"), F.array_join("vcf_info_LST", ",", ".").alias("lst"), F.col("vcf_ignored").isNotNull().alias("left_out"),
    )


def vcf_records(spark: SparkSession, d: str) -> DataFrame:
    return _allele_rows(read_vcf(spark, _orders_vcf(spark, d)).alleles)


def vcf_region(spark: SparkSession, d: str) -> DataFrame:
    return _allele_rows(read_vcf(spark, _orders_vcf(spark, d), "c7", 300, 600).alleles)


def vcf_samples(spark: SparkSession, d: str) -> DataFrame:
    t = read_vcf(spark, _orders_vcf(spark, d))
    return t.samples.join(t.alleles.select("vcf_rec", F.col("vcf_info_KEY").alias("key")).distinct(), "vcf_rec").select("key", F.col("vcf_sample").alias("sample"), F.col("GT").alias("gt"), F.col("DP").alias("dp"))


def seq_distance(spark: SparkSession, d: str) -> DataFrame:
    """Edits between the sequences of merged records and of calls of their kind nearby."""
    merged = spark.read.parquet(f"{d}/merged_callset.parquet").withColumn("_index", F.col("mg_index"))
    calls = _calls(spark, d).withColumn("_index", F.col("call_id"))
    a, b = F.upper(F.trim("seq_a")), F.upper(F.trim("seq_b"))
    cols = ("index_a", "index_b", Extra(edit_distance_column(a, b), "edits", frozenset({"seq"})), Extra(edit_distance_column(a, b, True) <= edit_distance_column(a, b), "part_is_less", frozenset({"seq"})))
    join = PairwiseOverlap(({"size_ro_min": 0.7, "offset_max": 3_000_000, "match_vartype": True, "join_predicates": ["length(trim(seq_a)) > 0 and length(trim(seq_b)) > 0"]},), join_cols=cols, drop_default_join_cols=True)
    return join.join(merged, calls, retain_index=True)


def fasta_info(spark: SparkSession, d: str) -> DataFrame:
    """Each part's name as a FASTA record, with its index."""
    part = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("n"), F.regexp_replace("p_name", r"\s", "").alias("s"))
    path = new_path(spark, "fasta")
    part.select(F.concat(F.lit(">"), "n", F.lit(" x\n"), F.substring("s", 1, 5), F.lit("\n"), F.substring("s", F.lit(6), F.length("s"))).alias("value")).coalesce(1).write.text(f"{path}/fa")
    part.select(F.concat_ws("\t", "n", F.length("s").cast("string"), F.lit("0"), F.lit("5"), F.lit("6")).alias("value")).coalesce(1).write.text(f"{path}/fai")
    return fa_info(spark, f"{path}/fa", f"{path}/fai").select("chrom", "len", "md5")


QUERIES = {f.__name__: f for f in (variant_ids, variant_sort, variant_cast, id_version, lead_src, kmer_stream, kmer_canonical, kmer_minimizer, kmer_jaccard, dotplot_points, dotplot_lines, cigar_parse, affine_score, vcf_alleles, vcf_symbolic, vcf_round_trip, vcf_records, vcf_region, vcf_samples, seq_distance, fasta_info)}

_REVCOMP = "reverse(translate({}, 'ACGT', 'TGCA'))"
_KMERS = "k as (select kmer, p from (select unnest([{{'t': upper(substr(seq, i::int + 1, 9)), 'i': i}} for i in range(0, length(seq) - 8)]) x from variant_calls where length(seq) >= 9) t, lateral (select x.t kmer, x.i p) where regexp_full_match(kmer, '[ACGT]+'))".replace("{{", "{").replace("}}", "}")
_PAIR = "p as (select call_id, upper(seq) a, substr(upper(seq), 5) || 'ACGTACGTACGT' b from variant_calls where seq is not null)"
_CIGAR = "c as (select l_orderkey, l_linenumber, l_quantity::bigint m1, l_suppkey % 40 + 1 i, l_partkey % 9 + 1 x, l_orderkey % 60 + 1 d, l_partkey % 50 + 1 m2 from lineitem)"
_POINTS = f"""q as (select call_id, upper(seq) a, {_REVCOMP.format("upper(seq)")} b from variant_calls where seq is not null),
kx as (select call_id, unnest([{{'t': substr(a, i::int + 1, 11), 'i': i}} for i in range(0, length(a) - 10)]) v from q),
ky as (select call_id, unnest([{{'t': substr(b, i::int + 1, 11), 'i': i}} for i in range(0, length(b) - 10)]) v from q),
pt as (select kx.call_id, kx.v.i x, ky.v.i y, '+' strand from kx join ky on kx.call_id = ky.call_id and kx.v.t = ky.v.t where regexp_full_match(kx.v.t, '[ACGT]+')
  union all select kx.call_id, kx.v.i, ky.v.i, '-' from kx join ky on kx.call_id = ky.call_id and kx.v.t = {_REVCOMP.format("ky.v.t")} where regexp_full_match(kx.v.t, '[ACGT]+'))"""

# What each kind of order gives, allele by allele (k is the kind).
_VCF_SQL = """with v as (select o_orderkey key, o_custkey, (o_orderkey % 6)::int k, 'c' || (o_custkey % 25) chrom, o_custkey % 1000 + 99 p0, o_custkey % 90 + 1 n, ['A', 'a', 'ACGTT', 'AC', 'N', 'N'][(o_orderkey % 6)::int + 1] r from orders),
al as (select * from (values (0, 1, 'snv', 'SNV', 0, 1, null, 'A', 'G', null), (1, 1, 'insdel', 'INS', 1, 1, 3, null, null, 'CGT'), (2, 1, 'insdel', 'DEL', 1, 4, 4, null, null, 'CGTT'),
  (3, 1, 'snv', 'SNV', 1, 1, null, 'C', 'G', null), (3, 2, 'insdel', 'INS', 2, 1, 2, null, null, 'TT'), (3, 3, 'insdel', 'DEL', 1, 1, 1, null, null, 'C'),
  (4, 1, 'insdel', 'DEL', 0, 0, 0, null, null, null), (5, 1, 'ignored', 'BND', null, null, null, null, null, null), (5, 2, 'ignored', null, null, null, null, null, null, null)) t(k, vcf_allele, kept_in, vartype, st, width, len, ref, alt, seq)),
x as (select key, vcf_allele::int vcf_allele, kept_in, chrom, case when k < 5 then p0 + st end pos, case when k = 4 then p0 + n else p0 + st + width end "end", vartype,
  case when k = 4 then n else len end::bigint varlen, ref, alt, seq, [ '', null, 'q1;q2', '', 'q1', null][k + 1] filters,
  case k when 0 then 0.5::double when 3 then vcf_allele / 10::double end af, k = 1 flg, case when k = 2 then '1,.,3' end lst, k = 5 left_out from v join al using (k))"""

SQL = {
    "variant_ids": """select call_id, case when upper(vartype) = 'SNV' then chrom || '-' || (pos + 1) || '-SNV-' || upper(ref) || upper(alt)
  else chrom || '-' || (pos + 1) || '-' || upper(vartype) || '-' || varlen end id from variant_calls""",
    "variant_sort": 'select call_id, row_number() over (order by chrom nulls first, pos nulls first, "end" nulls first, len(filter) nulls first, id nulls first, call_id) - 1 place from variant_calls',
    "variant_cast": "select call_id, chrom, pos, \"end\", id, vartype, varlen, ref, alt, len(filter)::int \"filter\" from variant_calls",
    "id_version": r"""with v as (select call_id, regexp_replace(id, '\.[0-9]*$', '') base, filter from variant_calls),
n as (select *, row_number() over (partition by base order by filter nulls first, call_id) - 1 n from v) select call_id, case when n > 0 then base || '.' || n else base end id from n""",
    "lead_src": "select mg_index, case when mg_src_lead >= 0 then mg_src[mg_src_lead + 1].src_name end src_name, case when mg_src_lead >= 0 then mg_src[mg_src_lead + 1].var_index end var_index from merged_callset",
    "kmer_stream": f"""with {_KMERS} select list_sum([(position(substr(kmer, j::int + 1, 1) in 'ACGT') - 1) * (4 ** (8 - j))::bigint for j in range(0, 9)])::bigint kmer, count(*) n, sum(p)::bigint places from k group by kmer""",
    "kmer_canonical": f"with {_KMERS} select least(kmer, {_REVCOMP.format('kmer')}) kmer, count(*) n from k group by 1",
    "kmer_minimizer": f"with {_KMERS} select list_min(flatten([[substr(kmer, j::int, 5), reverse(translate(substr(kmer, j::int, 5), 'ACGT', 'TGCA'))] for j in range(1, 6)])) minimizer, count(*) n from k group by 1",
    "kmer_jaccard": f"""with {_PAIR}, s as (select call_id, unnest([substr(a, i::int, 9) for i in range(1, length(a) - 7)]) k, 1 x, 0 y from p union all select call_id, unnest([substr(b, i::int, 9) for i in range(1, length(b) - 7)]), 0, 1 from p),
c as (select call_id, k, sum(x) x, sum(y) y from s where regexp_full_match(k, '[ACGT]+') group by all),
j as (select call_id, sum(least(x, y))::double / sum(greatest(x, y)) j from c group by call_id) select p.call_id, coalesce(j, 0) jaccard from p left join j using (call_id)""",
    "dotplot_points": f"with {_POINTS} select call_id, strand, count(*) n, sum(x)::bigint x, sum(y)::bigint y from pt group by all",
    "dotplot_lines": f"""with {_POINTS}, dg as (select *, case when strand = '+' then x - y else x + y end dd from pt),
rn as (select *, x - row_number() over (partition by call_id, strand, dd order by x) run from dg)
select call_id, strand, min(x) x_pos, max(x) + 11 x_end, min(y) y_pos, max(y) + 11 y_end, count(*) n_points from rn group by call_id, strand, dd, run""",
    "cigar_parse": f"""with {_CIGAR} select 7 op, 2 * count(*) n, sum(m1 + m2)::bigint bases from c union all select 1, count(*), sum(i)::bigint from c union all select 8, count(*), sum(x)::bigint from c
union all select 2, count(*), sum(d)::bigint from c union all select 4, count(*), (5 * count(*))::bigint from c""",
    "affine_score": f"""with {_CIGAR} select m1 || '=' || i || 'I' || x || 'X' || d || 'D' || m2 || '=5S' cigar,
  (2.0 * (m1 + m2) - 4.0 * x + greatest(-4.0 - 2.0 * i, -24.0 - i) + greatest(-4.0 - 2.0 * d, -24.0 - d))::double score from c""",
    "vcf_alleles": """with s as (select call_id, pos, case call_id % 3 when 0 then substr(seq, 1, 3) when 1 then seq else substr(seq, 1, 3) || 'ac' || substr(seq, 4) end r,
  case call_id % 3 when 0 then seq when 1 then substr(seq, 1, 3) else lower(substr(seq, 1, 3)) || 'G' || substr(seq, 4) end a from variant_calls where seq is not null),
t as (select *, list_max([k for k in range(0, least(length(r), length(a)) + 1) if k = 0 or upper(right(r, k)) = upper(right(a, k))]) sx from s),
u as (select call_id, pos, substr(r, 1, length(r) - sx) r, substr(a, 1, length(a) - sx) a from t),
v as (select *, list_max([k for k in range(0, least(length(r), length(a)) + 1) if upper(left(r, k)) = upper(left(a, k))]) px from u),
w as (select call_id, pos + px pos, substr(r, px::int + 1) r, substr(a, px::int + 1) a from v),
z as (select *, case when r = '' and a <> '' then 'INS' when r <> '' and a = '' then 'DEL' when length(r) = 1 and length(a) = 1 then 'SNV' else 'SUB' end t from w)
select call_id, t vartype, case t when 'INS' then length(a) when 'DEL' then length(r) when 'SUB' then length(r) + length(a) end varlen, case when t in ('SNV', 'SUB') then r end ref,
  case when t in ('SNV', 'SUB') then a end alt, case t when 'INS' then a when 'DEL' then r end seq, pos, pos + case when t in ('INS', 'SNV') then 1 else length(r) end "end" from z""",
    "vcf_symbolic": """with s as (select call_id, pos, upper(vartype) vt, case when call_id % 4 = 0 then abs(varlen) end sl, case when call_id % 4 = 1 then "end" end en, case when call_id % 4 = 2 then length(seq) end sq from variant_calls),
t as (select *, case when vt = 'INS' then coalesce(sl, sq) else coalesce(sl, en - pos, sq) end vl from s)
select call_id, vt vartype, vl varlen, pos, case when vt = 'INS' then pos + 1 else coalesce(en, pos + vl, pos + 1) end "end", vt = 'INS' and vl is null failed from t""",
    "vcf_round_trip": """with s as (select *, upper(regexp_replace(ref, '[^A-Za-z]', '', 'g')) r, upper(regexp_replace(alt, '[^A-Za-z]', '', 'g')) a from variant_calls where vartype = 'SNV' and chrom is not null)
select call_id, chrom, pos, pos + 1 "end", r ref, a alt, len(filter)::int n_filter, varlen from s where length(r) = 1 and length(a) = 1 and r <> a""",
    "vcf_records": f"{_VCF_SQL} select * from x",
    "vcf_region": f"{_VCF_SQL} select x.* from x join v using (key) where v.chrom = 'c7' and v.p0 < 600 and v.p0 + length(v.r) > 300",
    "vcf_samples": f"""{_VCF_SQL}, kept as (select distinct key from x where not left_out)
select key, 'S1' sample, '0|1' gt, (o_custkey % 7)::bigint dp from v join kept using (key)
union all select key, 'S2', ['./.', '0/0', '1/1', '0/0', '.', '0/0'][k + 1], case when k = 2 then 5 end from v join kept using (key)""",
    "seq_distance": """select a.mg_index index_a, b.call_id index_b, levenshtein(upper(trim(a.seq)), upper(trim(b.seq)))::int edits, true part_is_less
from merged_callset a join variant_calls b on a.chrom = b.chrom and a.vartype = b.vartype and abs(a.pos - b.pos) <= 3000000 and abs(a."end" - b."end") <= 3000000
where length(trim(a.seq)) > 0 and length(trim(b.seq)) > 0 and abs(a.varlen) > 0 and abs(b.varlen) > 0
  and (least(abs(a.varlen), abs(b.varlen))::double / greatest(abs(a.varlen), abs(b.varlen)))::float >= 0.7::float""",
    "fasta_info": r"select 'p' || p_partkey chrom, length(regexp_replace(p_name, '\s', '', 'g')) len, md5(upper(regexp_replace(p_name, '\s', '', 'g'))) md5 from part",
}
