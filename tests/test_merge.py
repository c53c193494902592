import random

import pytest

from strandlake.operators.merge import CallsetDef, LeadStrategy, MergeCumulative, normalize_callsets
from strandlake.operators.overlap import PairwiseOverlap
from strandlake.plans.interval_queries import cumulative_merge_callers
from strandlake.plans.strategy import MergeStrategy, Spec

SCHEMA = "chrom string, pos long, `end` long, id string"
JOIN = PairwiseOverlap(({"ro_min": 0.5},))


def frames(spark, *sources):
    return [spark.createDataFrame([("chr1", p, e, i) for p, e, i in s], SCHEMA).coalesce(1) for s in sources]


def clusters(merged):
    return sorted(sorted((s.src_index, s.var_index) for s in r.mg_src) for r in merged.collect())


def brute(sources):
    """The stated contract, step by step."""
    founders, groups = [], []
    for k, s in enumerate(sources):
        pairs = []
        for g, (p, e) in enumerate(founders):
            for i, (q, f, _) in enumerate(s):
                ro = max(0, min(e, f) - max(p, q)) / max(e - p, f - q)
                size = min(e - p, f - q) / max(e - p, f - q)
                prop = max(abs(p - q), abs(e - f)) / min(e - p, f - q)
                if ro >= 0.5:
                    pairs.append((-round(ro * 0.4 + size * 0.4 + (1 - min(prop, 2) / 2) * 0.2, 6), g, i))
        best_a, best_b = {}, {}
        for w, g, i in sorted(pairs):
            best_a.setdefault(g, (w, i))
        for g, (w, i) in sorted(best_a.items(), key=lambda x: (x[1][0], x[0])):
            best_b.setdefault(i, g)
        for i, g in best_b.items():
            groups[g].append((k, i))
        fresh = sorted((q, f, ident, i) for i, (q, f, ident) in enumerate(s) if i not in best_b)
        for q, f, _, i in fresh:
            founders.append((q, f))
            groups.append([(k, i)])
    return sorted(sorted(g) for g in groups)


def test_scenarios(spark):
    two = frames(spark, [(1000, 1100, "a0"), (2000, 2100, "a1")], [(1010, 1100, "b0"), (5000, 5100, "b1")])
    assert clusters(MergeCumulative(JOIN)(two)) == [[(0, 0), (1, 0)], [(0, 1)], [(1, 1)]]
    five = frames(spark, [(1000, 1100, "x")], [(3000, 3100, "x"), (9000, 9100, "x")], [(1005, 1100, "x")], [(3010, 3100, "x")], [(995, 1100, "x"), (7000, 7100, "x")])
    merged = MergeCumulative(JOIN)(five)
    assert clusters(merged) == [[(0, 0), (2, 0), (4, 0)], [(1, 0), (3, 0)], [(1, 1)], [(4, 1)]]
    first = merged.where("size(mg_src) = 3").first()
    assert (first.pos, first.mg_src_lead, len(first.mg_stat)) == (995, 2, 2)
    assert sorted(r.id for r in merged.collect()) == ["x", "x.1", "x.2", "x.3"]
    assert MergeCumulative(JOIN, "first")(five).where("size(mg_src) = 3").first().pos == 1000


def test_matches_the_contract_on_random_sets(spark):
    r = random.Random(3)
    sources = []
    for _ in range(3):
        s = []
        for i in range(25):
            p = r.randrange(0, 1500)
            s.append((p, p + r.choice([20, 50, 51, 80]), f"i{i}"))
        sources.append(s)
    assert clusters(MergeCumulative(JOIN)(frames(spark, *sources))) == brute(sources)


def test_columns_lengths_and_filters(spark):
    a = spark.createDataFrame([("c", 10, 11, 100, ["q"], 1), ("c", 900, 901, 5, None, 1)], "chrom string, pos long, `end` long, varlen long, filter array<string>, _private int").coalesce(1)
    b = spark.createDataFrame([("c", 12, 13, 98, "bb"), ("c", None, 1, 5, None)], "chrom string, pos long, `end` long, varlen long, note string").coalesce(1)
    merged = MergeCumulative(JOIN)([(a, "A", {"k": 1}), (b, "A", "text")])
    assert merged.columns == ["chrom", "pos", "end", "varlen", "filter", "id", "note", "mg_src", "mg_stat", "mg_src_lead"]
    got = {r.pos: r for r in merged.collect()}
    assert [(s.src_name, s.src_meta, s.var_id) for s in got[10].mg_src] == [("A", '{"k": 1}', "var0"), ("A.1", "text", "var0")]
    assert got[900]["filter"] == [] and got[10]["filter"] == ["q"] and got[10].note is None and None in got
    some = MergeCumulative(JOIN)([a, b], pre_filter="pos < 100")
    assert [(r.pos, r.mg_src[0].var_index) for r in some.collect()] == [(10, 0)]
    assert MergeCumulative(JOIN)([a.limit(0), b.limit(0)]).collect() == []


def test_every_call_of_the_callers_stands_in_one_group(spark, tmp_path):
    calls = [(0, "A-1", "c", 10), (1, "B-1", "c", 10), (2, "A-2", None, 10), (3, "B-2", None, 10), (4, None, "c", 10), (5, None, "d", 10), (6, None, None, None)]
    rows = [(i, src, c, p, p and p + 9, f"i{i}", "DEL", 9, [], "ACGT") for i, src, c, p in calls]
    schema = "call_id long, src_name string, chrom string, pos long, `end` long, id string, vartype string, varlen long, filter array<string>, seq string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/variant_calls.parquet")
    got = cumulative_merge_callers(spark, str(tmp_path)).collect()
    assert sorted((r.chrom or "", r.n_src) for r in got) == [("", 1), ("", 1), ("", 1), ("c", 3), ("d", 1)]


def test_definitions(spark):
    df = frames(spark, [])[0]
    names = [c.name for c in normalize_callsets([df, (df,), (df, "x"), (df, "x", {}), (df, None), CallsetDef(df, "x")])]
    assert names == ["source_1", "source_2", "x", "x.1", "source_5", "x.2"]
    assert normalize_callsets([(df, "x", {})])[0].meta == "{}"
    with pytest.raises(ValueError):
        normalize_callsets([(df, 1, 2, 3)])
    with pytest.raises(ValueError):
        MergeCumulative(JOIN)([])
    assert MergeCumulative(JOIN, "LEFT").lead_strategy is LeadStrategy.LEFT


def test_strategy_text():
    s = MergeStrategy.parse("nr::ro(0.5):szro(0.8,1k,szdist=2.0):exact(ref=true):distance(unlimited, 0.5, match(0.9)):match")
    stages, model = s.compile()
    assert [(x.ro_min, x.size_ro_min, x.offset_max, x.offset_prop_max, x.match_ref, x.match_prop_min) for x in stages] == [(0.5, None, None, None, False, 0.8), (None, 0.8, 1000, 2.0, False, 0.8), (None, None, 0, None, True, 0.8), (None, None, None, 0.5, False, 0.9)]
    assert model.map_limit == 5000 and s.match == Spec("match")
    assert MergeStrategy.parse("nr::ro").compile()[0][0].ro_min == 0.5
    assert MergeStrategy.parse("nr::ro(,10)").compile()[0][0].offset_max == 10
    assert MergeStrategy.parse("nr::ro(0.5):match(gap=[4,2],limit=unlimited,ksize=5)").overlap().match_score_model.affine_gap == ((4.0, 2.0),)
    for bad in ("", "nr", "nr:ro", "zz::ro", "nr::nope", "nr::ro(", "nr::ro(2)", "nr::ro(0.5,x)", "nr::ro(ro=0.1,0.2)", "nr::ro(0.1,ro=0.2)", "nr::distance(unlimited)", "nr::match", "nr::ro:match:match", "nr::ro(0.5)!", "nr::exact(1)", "nr::ro(0.5):match(gap=[1])", "nr::ro(match(match))"):
        with pytest.raises(ValueError):
            MergeStrategy.parse(bad)
