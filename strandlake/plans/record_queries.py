"""Queries (and their DuckDB SQL) of the core operators on record sets: problems 1, 2, 3 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import drift, row_parse
from strandlake.operators.dense_aggregate import dense_key_aggregate, heavy_keys
from strandlake.operators.periods import merge_periods
from strandlake.session import stage


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(spark.read.parquet(f"{d}/variant_calls.parquet"), "chrom", 0.05).select("chrom")


def p1_chrom_summary(spark: SparkSession, d: str) -> DataFrame:
    return dense_key_aggregate(spark.read.parquet(f"{d}/variant_calls.parquet"), "chrom", ["varlen", "pos", "end"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(spark.read.parquet(f"{d}/info_header.parquet")).select("file_id", "field_id", "change")


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    headers = spark.read.parquet(f"{d}/info_header.parquet")
    names = stage(drift.canonical_fields(headers), "names")
    table = drift.ingest(spark.read.parquet(f"{d}/info_record.parquet"), headers, drift.choose_target(headers, names=names), names=names, fitted="_fitted")
    return drift.promote_all(table, names, "_fitted")


def p2_fields(spark: SparkSession, d: str) -> DataFrame:
    """The name that every declared field of every file has in the one table."""
    return drift.canonical_fields(spark.read.parquet(f"{d}/info_header.parquet"))


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """The whole of p2_table by field: typed values, their total (of numbers, or of the texts' lengths) and rescued entries."""
    table = stage(p2_table(spark, d), "table")
    kinds = dict(table.dtypes)
    none = F.lit(None)

    def cell(name, integers=none, floats=none, flag=none, strings=none):
        return F.struct(F.lit(name).alias("field"), integers.cast("array<bigint>").alias("integers"), floats.cast("array<double>").alias("floats"), flag.cast("boolean").alias("flag"), strings.cast("array<string>").alias("strings"))

    slot = {"bigint": "integers", "double": "floats", "string": "strings"}
    cells = []
    for c in table.columns:
        if c in ("file_id", "vcf_rec", drift.PROMOTED, drift.RESCUED):
            continue
        kind, v = kinds[c], F.col(f"`{c}`")
        listed = kind.startswith("array<")
        cells.append(F.when(v.isNotNull(), cell(c, flag=v) if kind == "boolean" else cell(c, **{slot[kind[6:-1] if listed else kind]: v if listed else F.array(v)})))
    wide = table.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.*")
    mapped = table.select(F.explode(drift.PROMOTED)).select(F.col("key").alias("field"), "value.integers", "value.floats", "value.flag", "value.strings")
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.coalesce(f(x).cast("double"), F.lit(0.0)))
    typed = wide.unionByName(mapped).where("integers is not null or floats is not null or flag is not null or strings is not null")
    typed = typed.select("field", F.coalesce(total("integers", lambda x: x), total("floats", lambda x: x), F.when(F.col("flag"), F.lit(1.0)), total("strings", F.length)).alias("total"), F.lit(0).alias("n_rescued"), F.lit(1).alias("n_typed"))
    rescued = table.select(F.explode(F.from_json(drift.RESCUED, "array<struct<field:string,value:string>>")).alias("e")).select("e.field", F.lit(0.0).alias("total"), F.lit(1).alias("n_rescued"), F.lit(0).alias("n_typed"))
    return typed.unionByName(rescued).groupBy("field").agg(F.sum("n_typed").alias("n_typed"), F.sum("n_rescued").alias("n_rescued"), F.round(F.sum("total"), 3).alias("total"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return merge_periods(spark.read.parquet(f"{d}/bed_track.parquet"), ["track", "chrom"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/ignored_line.parquet")
    return row_parse.rejected_rows(lines, "raw_line", row_parse.IGNORED_ROW).select("line_id", F.col("reject_reason").alias("reason"))


def p7_rejected(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p7_found with the first field at which each stops being valid."""
    lines = spark.read.parquet(f"{d}/ignored_line.parquet")
    return row_parse.rejected_rows(lines, "raw_line", row_parse.IGNORED_ROW).select("line_id", F.col("reject_reason").alias("reason"), F.col("reject_field").alias("field"))


def p7_loaded(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/ignored_line.parquet")
    rows = row_parse.load_rows(lines, "raw_line", row_parse.IGNORED_ROW, ["line_id", "file_id"])
    return rows.withColumn("filter", F.array_join("filter", ";")).withColumn("vcf_qual", F.col("vcf_qual").cast("double"))


QUERIES = {f.__name__: f for f in (p1_found, p1_chrom_summary, p2_found, p2_table, p2_fields, p2_values, p3_found, p7_found, p7_rejected, p7_loaded)}

_NUM = r"case when trim(number) in ('A','R','G','.') then trim(number) when regexp_full_match(trim(number), '[0-9]+') then regexp_replace(trim(number), '^0+([0-9])', '\1') else '.' end"
_QUOTED = r'"[^"]*(?:""[^"]*)*"'
_CELL = rf'(?:{_QUOTED}|[^",]*)'

# One column per field: where the first fields of a row are well formed, the text of the field, else null.
_PREFIX_CELLS = ",\n".join(
    rf"case when regexp_matches(raw_line, '^(?:{_CELL},){{{i}}}{_CELL}(?:,|$)') then regexp_extract(raw_line, '^(?:{_CELL},){{{i}}}({_CELL})(?:,|$)', 1) end c{i + 1}"
    for i in range(11)
)
_BARE_CELL = "case when starts_with(c{0}, '\"') then replace(substr(c{0}, 2, length(c{0}) - 2), '\"\"', '\"') else c{0} end"
_INTEGER = "regexp_full_match(f{0}, '[0-9]+') and try_cast(f{0} as {1}) is not null"
_VALID = [
    "f1 <> ''", "true", "f3 in ('BND', 'TRA', '')", "f4 <> ''", _INTEGER.format(5, "bigint"), "true", "f7 <> ''", "f8 <> ''",
    r"regexp_full_match(f9, '([0-9]+(\.[0-9]+)?)?')", _INTEGER.format(10, "bigint"), _INTEGER.format(11, "int"),
]

_CELLS = rf"""
cells as (select *, [case when starts_with(c, '"') then replace(substr(c, 2, length(c) - 2), '""', '"') else c end for c in
    [case when starts_with(m, ',') then substr(m, 2) else m end for m in regexp_extract_all(',' || raw_line, ',{_CELL}')]] f
  from ignored_line where regexp_full_match(raw_line, '{_CELL}(?:,{_CELL})*')),
judged as (select *, len(f) <> 11 as wrong_count,
    len(f) = 11 and (f[1] = '' or f[4] = '' or f[7] = '' or f[8] = '' or f[3] not in ('BND', 'TRA', '')
      or not coalesce(regexp_full_match(f[5], '[0-9]+') and try_cast(f[5] as bigint) is not null, false)
      or not coalesce(regexp_full_match(f[10], '[0-9]+') and try_cast(f[10] as bigint) is not null, false)
      or not coalesce(regexp_full_match(f[11], '[0-9]+') and try_cast(f[11] as int) is not null, false)
      or not regexp_full_match(f[9], '([0-9]+(\.[0-9]+)?)?')) as wrong_value from cells)
"""

_DECLARED = f"""line as (select file_id, pipeline, file_no, id, {_NUM} num,
    case when type in ('Integer','Float','Flag','Character','String') then type else 'String' end typ, description,
    row_number() over (partition by file_id, id order by line_no) rn from info_header where id is not null),
one as (select * from line where rn = 1),
f as (select file_id, lead(file_id) over (partition by pipeline order by file_no) nxt, lag(file_id) over (partition by pipeline order by file_no) prv
  from (select distinct file_id, pipeline, file_no from info_header)),
cur as (select o.* from one o join f using (file_id) where prv is not null),
pre as (select f.nxt file_id, id, num, typ, description from one o join f using (file_id) where nxt is not null),
both_sides as (select coalesce(c.file_id, p.file_id) file_id, c.id cid, p.id pid, c.num cn, p.num pn, c.typ ct, p.typ pt, c.description cd, p.description pd
  from cur c full join pre p on c.file_id = p.file_id and c.id = p.id),
gone as (select file_id, pid, pn, pt, pd, row_number() over (partition by file_id, pd order by pid) rn from both_sides where cid is null),
fresh as (select b.file_id, b.cid, b.cn, b.ct, b.cd, g.pid, g.pn, g.pt from both_sides b left join gone g on g.file_id = b.file_id and g.pd = b.cd and g.rn = 1 where b.pid is null)"""

# Every rename leads to the first later one of its new name; a field takes the last name it is led to.
_NAMES = f"""{_DECLARED},
placed as (select file_id, pipeline, row_number() over (partition by pipeline order by file_no, file_id) pos from (select distinct file_id, pipeline, file_no from info_header)),
edges as materialized (select pipeline, pos, pid old, min(cid) name from fresh join placed using (file_id) where pid is not null group by all),
walk as (select file_id, id, pipeline, pos, id name, 0 depth from one join (select file_id, pos from placed) using (file_id)
  union all select w.file_id, w.id, w.pipeline, e.pos, e.name, depth + 1 from walk w join edges e on e.pipeline is not distinct from w.pipeline and e.old = w.name and e.pos > w.pos
    where not exists (select 1 from edges n where n.pipeline is not distinct from w.pipeline and n.old = w.name and n.pos > w.pos and n.pos < e.pos)),
names as materialized (select file_id, id field_id, arg_max(name, depth) canonical from walk group by all),
named as materialized (select n.*, o.num number, o.typ "type" from names n join one o on o.file_id = n.file_id and o.id = n.field_id)"""


def _fits(value: str, number: str, kind: str) -> str:
    """(fits, values, total) of a raw value under a declaration, as a struct."""
    integer = "regexp_full_match({0}, '\\s*[+-]?[0-9]+\\s*') and try_cast({0} as bigint) is not null"
    real = "regexp_full_match({0}, '\\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\\s*')"
    good = f"case {kind} when 'Integer' then {integer.format('p')} when 'Float' then {real.format('p')} else true end"
    size = f"case when p = '.' then 0 when {kind} = 'Integer' then coalesce(try_cast(p as bigint), 0)::double when {kind} = 'Float' then coalesce(try_cast(p as double), 0) else length(p)::double end"
    parts = f"case when {number} in ('0', '1') then [{value}] else string_split({value}, ',') end"
    return f"""case when {kind} = 'Flag' then {{'good': {value} is null or {value} = '', 'seen': true, 'total': 1.0::double}}
    when {value} is null then {{'good': false, 'seen': false, 'total': 0.0::double}}
    else {{'good': len(list_filter({parts}, lambda p: not (p = '.' or {good}))) = 0, 'seen': {value} <> '.', 'total': list_sum(list_transform({parts}, lambda p: {size}))::double}} end"""


SQL = {
    "p2_fields": f"with recursive {_NAMES} select file_id, field_id, canonical, number, type from named",
    "p2_values": f"""with recursive {_NAMES},
target as (select canonical, number, type from (select canonical, number, type, count(*) n from named group by all) qualify row_number() over (partition by canonical order by n desc, number desc, type desc) = 1),
own as (select file_id, canonical, number, type from named qualify row_number() over (partition by file_id, canonical order by canonical <> field_id, number, type) = 1),
rec as (select *, row_number() over () rid, string_split(trim(info_text), ';') parts from info_record),
ent as (select rid, file_id, unnest(list_transform(parts, lambda p, i: {{'i': i, 'p': p}})) e from rec where info_text is not null),
entry as (select rid, file_id, e.i i, split_part(e.p, '=', 1) f, case when contains(e.p, '=') then regexp_replace(e.p, '^[^=]*=', '') end v from ent where e.p not in ('', '.')),
known as (select rid, e.file_id, i, coalesce(n.canonical, f) canonical, v from entry e left join named n on n.file_id = e.file_id and n.field_id = e.f),
ranked as (select *, row_number() over (partition by rid, canonical order by i) nth from known),
judged as (select canonical, nth, case when t.canonical is not null then {_fits("v", "t.number", "t.type")} end t, case when o.canonical is not null then {_fits("v", "o.number", "o.type")} end o
  from ranked r left join (select canonical, number, type from target) t using (canonical) left join own o using (file_id, canonical)),
fate as (select canonical, case when nth > 1 then null when coalesce(t.good, false) then t when coalesce(o.good, false) then o end x from judged)
select canonical field, count(*) filter (x is not null and x.seen) n_typed, count(*) filter (x is null) n_rescued, round(coalesce(sum(x.total) filter (x is not null and x.seen), 0), 3) total from fate
group by canonical having n_typed + n_rescued > 0""",
    "p1_found": "select chrom from variant_calls where chrom is not null group by chrom having count(*) > 0.05 * (select count(*) from variant_calls)",
    "p1_chrom_summary": """select chrom, count(*) n_rows,
  count(varlen) varlen_n, sum(varlen)::bigint varlen_sum, min(varlen) varlen_min, max(varlen) varlen_max,
  count(pos) pos_n, sum(pos)::bigint pos_sum, min(pos) pos_min, max(pos) pos_max,
  count("end") end_n, sum("end")::bigint end_sum, min("end") end_min, max("end") end_max
from variant_calls group by chrom""",
    "p2_found": f"""with {_DECLARED}
select file_id, cid field_id, case when pid is null then 'added' else 'renamed' end change from fresh
union all select file_id, cid, 'number' from fresh where pn <> cn
union all select file_id, cid, 'type' from fresh where pt <> ct
union all select file_id, cid, 'number' from both_sides where cid is not null and pid is not null and pn <> cn
union all select file_id, cid, 'type' from both_sides where cid is not null and pid is not null and pt <> ct
union all select file_id, pid, 'removed' from gone where not exists (select 1 from fresh where fresh.file_id = gone.file_id and fresh.cd = gone.pd)""",
    "p3_found": """with v as (select track, chrom, pos, "end" e from bed_track where track is not null and chrom is not null and pos is not null and "end" >= pos),
m as (select *, max(e) over (partition by track, chrom order by pos, e rows between unbounded preceding and 1 preceding) reach from v),
g as (select *, sum(case when reach is null or pos > reach then 1 else 0 end) over (partition by track, chrom order by pos, e rows unbounded preceding) g from m),
p as (select track, chrom, min(pos) s, max(e) e from g group by track, chrom, g),
l as (select *, lead(s) over (partition by track, chrom order by s) n from p)
select 'period' kind, track, chrom, s span_pos, e span_end from p union all select 'gap', track, chrom, e, n from l where n is not null""",
    "p7_found": f"""with {_CELLS}
select line_id, 'quoting' reason from ignored_line where raw_line is not null and not regexp_full_match(raw_line, '{_CELL}(?:,{_CELL})*')
union all select line_id, case when wrong_count then 'columns' else 'value' end from judged where wrong_count or wrong_value
union all select line_id, 'columns' from ignored_line where raw_line is null""",
    "p7_rejected": f"""with {_CELLS},
reasons as (select line_id, 'quoting' reason from ignored_line where raw_line is not null and not regexp_full_match(raw_line, '{_CELL}(?:,{_CELL})*')
  union all select line_id, case when wrong_count then 'columns' else 'value' end from judged where wrong_count or wrong_value
  union all select line_id, 'columns' from ignored_line where raw_line is null),
cut as (select line_id, {_PREFIX_CELLS} from ignored_line),
bare as (select line_id, {", ".join(f"{_BARE_CELL.format(i)} f{i}" for i in range(1, 12))} from cut),
first as (select line_id, case {" ".join(f"when not coalesce(f{i} is not null and {_VALID[i - 1]}, false) then '{f.name}'" for i, f in enumerate(row_parse.IGNORED_ROW.fields, 1))} end field from bare)
select line_id, reason, field from reasons join first using (line_id)""",
    "p7_loaded": f"""with {_CELLS}
select line_id, file_id, f[1] chrom, array_to_string(string_split(nullif(f[2], ''), ';'), ';') "filter", nullif(f[3], '') vartype, f[4] vcf_ignored, f[5]::bigint vcf_pos,
  nullif(f[6], '') vcf_id, f[7] vcf_ref, f[8] vcf_alt, nullif(f[9], '')::float::double vcf_qual, f[10]::bigint vcf_rec, f[11]::int vcf_allele
from judged where not wrong_count and not wrong_value""",
}
