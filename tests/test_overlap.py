import math
import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions.segments import segment_overlap
from strandlake.operators.overlap import OverlapStage, PairwiseOverlap
from strandlake.operators.weights import DEFAULT_WEIGHTS, ElementPriority, WeightColumn, WeightElement, WeightStrategy

from .conftest import rows

SCHEMA = "chrom string, pos long, `end` long, id string, varlen long, ref string, alt string, vartype string, filter array<string>, seq string, ro string"


def table(n, seed):
    r, out = random.Random(seed), []
    for i in range(n):
        p, n_ = r.randrange(0, 400), r.choice([0, 1, 2, 5, 10, 40, 100])
        ins = r.random() < 0.4
        out.append((r.choice(["c1", "c2", None] if i % 10 == 0 else ["c1", "c2"]), p, p + 1 if ins else p + n_, f"v{i}", -n_ if i % 4 == 0 else n_, r.choice(["a", " A", "c", None]), r.choice("gt"), "INS" if ins else "DEL", r.choice([[], ["q"], None]), None, "clash"))
    return out


A, B = table(60, 1), table(70, 2)


def measures(a, b):
    la, lb = abs(a[4]), abs(b[4])
    dist = max(abs(a[1] - b[1]), abs(a[2] - b[2]))
    div = lambda x, y: x / y if y else math.nan if x == 0 else math.inf
    ro = math.nan if max(la, lb) == 0 else min(max((min(a[1] + la, b[1] + lb) - max(a[1], b[1])) / max(la, lb), 0), 1)
    return ro, div(min(la, lb), max(la, lb)), dist, div(dist, min(la, lb))


STAGES = {
    "ro": ({"ro_min": 0.5}, lambda a, b, m: m[0] >= 0.5 - 1e-7),
    "any": ({"ro_min": 0}, lambda a, b, m: m[0] > 0),
    "size": ({"size_ro_min": 0.5}, lambda a, b, m: m[1] >= 0.5),
    "same size": ({"size_ro_min": 1}, lambda a, b, m: m[1] == 1),
    "offset": ({"offset_max": 7}, lambda a, b, m: m[2] <= 7),
    "exact": ({"offset_max": 0}, lambda a, b, m: m[2] == 0),
    "prop": ({"offset_prop_max": 1.5}, lambda a, b, m: m[3] <= 1.5),
    "alleles": ({"match_ref": True, "match_alt": True}, lambda a, b, m: None not in (a[5], b[5]) and a[5].strip().upper() == b[5].strip().upper() and a[6] == b[6]),
    "type": ({"match_vartype": True, "offset_max": 30}, lambda a, b, m: a[7] == b[7] and m[2] <= 30),
    "filter": ({"match_filter_pass": True, "ro_min": 0.2}, lambda a, b, m: None not in (a[8], b[8]) and (a[8] == []) == (b[8] == []) and m[0] >= 0.2 - 1e-7),
    "xor": ({"match_filter_pass": True, "compat_filter_xor": True, "ro_min": 0.2}, lambda a, b, m: None not in (a[8], b[8]) and (a[8] == []) != (b[8] == []) and m[0] >= 0.2 - 1e-7),
    "own": ({"join_predicates": ["pos_a < pos_b"], "join_filters": ["offset_dist < 5"]}, lambda a, b, m: a[1] < b[1] and m[2] < 5),
    "all": ({"ro_min": 0.2, "size_ro_min": 0.3, "offset_max": 50, "offset_prop_max": 2.0}, lambda a, b, m: m[0] >= 0.2 - 1e-7 and m[1] >= 0.3 - 1e-7 and m[2] <= 50 and m[3] <= 2),
}


def want(rule):
    return {(i, j) for i, a in enumerate(A) for j, b in enumerate(B) if a[0] is not None and a[0] == b[0] and rule(a, b, measures(a, b))}


def indexed(spark, data):
    return spark.createDataFrame([(i, *x) for i, x in enumerate(data)], "_index long, " + SCHEMA)


@pytest.mark.parametrize("name", STAGES)
def test_stage_matches_brute_force(spark, name):
    stage, rule = STAGES[name]
    got = PairwiseOverlap((stage,)).join(indexed(spark, A), indexed(spark, B), retain_index=True).collect()
    assert len(got) == len({(r.index_a, r.index_b) for r in got})
    assert {(r.index_a, r.index_b) for r in got} == want(rule)
    for r in got:
        m = measures(A[r.index_a], B[r.index_b])
        for have, x in zip((r.ro, r.size_ro, r.offset_dist, r.offset_prop), m, strict=True):
            assert (math.isnan(have) and math.isnan(x)) or have == pytest.approx(x, rel=1e-6)


def test_stages_unite_with_the_best_weight(spark):
    stages = (STAGES["ro"][0], STAGES["offset"][0], STAGES["alleles"][0])
    got = PairwiseOverlap(stages).join(indexed(spark, A), indexed(spark, B), retain_index=True)
    pairs = [(r.index_a, r.index_b) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want(STAGES["ro"][1]) | want(STAGES["offset"][1]) | want(STAGES["alleles"][1])


def test_golden_values_and_types(spark):
    schema = "chrom string, pos long, `end` long, varlen long"
    one = lambda *x: spark.createDataFrame([x], schema)
    join = PairwiseOverlap(({"ro_min": 0.0},))
    for a, b, expected in (
        (("chr1", 100, 101, 100), ("chr1", 120, 121, 100), (0.8, 20, 0.2, 1.0, 0.90)),
        (("chr1", 120, 121, 10), ("chr1", 120, 121, 8), (0.8, 0, 0.0, 0.8, 0.84)),
        (("chr1", 120, 130, 10), ("chr1", 120, 128, 8), (0.8, 2, 0.25, 0.8, 0.815)),
        (("chr2", 200, 201, 1), ("chr2", 200, 201, 1), (1.0, 0, 0.0, 1.0, 1.0)),
    ):
        df = join.join(one(*a), one(*b))
        r = df.first()
        assert (r.ro, r.offset_dist, r.offset_prop, r.size_ro, r.weight) == pytest.approx(expected, rel=1e-6) and r.match_prop is None
    assert [t for _, t in df.dtypes] == ["bigint", "bigint", "string", "string", "float", "int", "float", "float", "float", "float"]


def test_sequence_match_with_filter(spark):
    schema = "chrom string, pos long, `end` long, varlen long, seq string"
    a = spark.createDataFrame([("c", 5, 6, 10, "CTGGCCAGAA"), ("c", 5, 6, 1, "C"), ("c", 5, 6, 4, None)], schema)
    b = spark.createDataFrame([("c", 5, 6, 8, "ctgcccag"), ("c", 5, 6, 1, "T"), ("c", 5, 6, 10, " CTGGCCAGAA ")], schema)
    got = {(r.index_a, r.index_b): r.match_prop for r in PairwiseOverlap(({"offset_max": 0, "match_prop_min": 0.0},)).join(a.coalesce(1), b.coalesce(1)).collect()}
    assert got[0, 0] == 0.5 and got[1, 1] == 0.0 and got[0, 2] == 1.0 and got[2, 0] == 0.0 and len(got) == 9
    some = PairwiseOverlap(({"offset_max": 0, "match_prop_min": 0.5},)).join(a.coalesce(1), b.coalesce(1))
    assert {(r.index_a, r.index_b) for r in some.collect()} == {(0, 0), (0, 2)}


def test_null_lengths_measure_nothing(spark):
    schema = "chrom string, pos long, `end` long, varlen long"
    a, b = spark.createDataFrame([("c", 1, 9, None)], schema), spark.createDataFrame([("c", 1, 9, 8)], schema)
    r = PairwiseOverlap(({"offset_max": 0},)).join(a, b).first()
    assert (r.ro, r.size_ro, r.offset_prop, r.offset_dist, r.weight) == (None, None, None, 0, None)
    for stage in ({"ro_min": 0}, {"size_ro_min": 0.1}, {"offset_prop_max": 9.0}):
        assert PairwiseOverlap((stage,)).join(a, b).collect() == []


def test_columns_definitions_and_errors(spark):
    a, b = indexed(spark, A), indexed(spark, B)
    join = PairwiseOverlap.from_definition({"stages": [{"ro_min": 0.5}], "join_cols": [("pos_a + 1", "p"), "id_b"], "drop_default_join_cols": True})
    assert join.join(a, b).columns == ["p", "id_b"]
    assert PairwiseOverlap.from_definition([{"ro_min": 0.5}, {"offset_max": 3}]).join(a.limit(0), b).collect() == []
    assert len(list(join.join_iter(a, b))) == 2
    for bad in ({"stages": [], "x": 1}, {"join_cols": []}, {"stages": []}):
        with pytest.raises(ValueError):
            PairwiseOverlap.from_definition(bad)
    for bad in ({"ro_min": 1.1}, {"size_ro_min": 0}, {"offset_max": -1}, {"offset_prop_max": -0.1}, {"match_prop_min": 2}, {"offset_max": 1.5}):
        with pytest.raises(ValueError):
            OverlapStage(**bad)
    with pytest.raises(ValueError):
        PairwiseOverlap(({"match_ref": True},)).join(a.drop("ref"), b)
    assert PairwiseOverlap(({"match_ref": True, "match_prop_min": 0.5},)).required_cols == {"chrom", "pos", "end", "ref", "seq"}
    assert join.check_reserved_cols(a) == {"_index"} and PairwiseOverlap(({"match_ref": True},)).check_required_cols(a.drop("ref")) == {"ref"}
    with pytest.raises(ValueError):
        PairwiseOverlap(({"ro_min": 0.5},)).join(a.withColumn("pos", F.col("filter")), b)


def test_weights(spark):
    df = spark.createDataFrame([(0.5, None, 3.0), (None, None, 1.0), (1.0, 0.25, -1.0)], "x double, y double, z double").coalesce(1)
    val = lambda s: [None if r[0] is None else pytest.approx(r[0]) for r in df.select(s.expr(df.columns)).collect()]
    assert val(WeightColumn("z", 2, (0, 2, True))) == [0.0, 1.0, 2.0]
    assert val(WeightElement(("x", 1), ("y", 1))) == [None, None, 1.25]
    assert val(WeightElement(("x", 1), ("y", 1, None, 0.5), missing=9)) == [1.0, 9.0, 1.25]
    assert val(WeightStrategy([("y", 1)], [("x", 0.1)])) == [0.05, None, 0.25]
    assert val(WeightStrategy([("y", 1)], [("x", 4)], priority=ElementPriority.FIRST)) == [2.0, None, 0.25]
    assert val(WeightStrategy([("absent", 1)], [("x", 1)])) == [0.5, None, 1.0]
    assert DEFAULT_WEIGHTS.elements[0].max_weight == pytest.approx(1) and DEFAULT_WEIGHTS.cols == {"ro", "size_ro", "offset_prop", "match_prop"}
    for bad in ((2, 1), (None, 1), (1, 1), (-1, 0), (1, 2, True, 4)):
        with pytest.raises(ValueError):
            WeightColumn("x", 1, bad)


def test_segments(spark):
    seg = "array<struct<pos:bigint,end:bigint,qry_pos:bigint,qry_end:bigint>>"
    schema = f"seg_a {seg}, qry_pos_a long, qry_end_a long, seg_b {seg}, qry_pos_b long, qry_end_b long"
    one, half = [(0, 100, 0, 100)], [(50, 150, 0, 100)]
    data = [(one, 0, 100, one, 0, 100), (one, 0, 100, half, 0, 100), (one, 0, 120, half, 110, 0), ([], 0, 100, one, 0, 100), (None, 0, 100, one, 0, 100), ([(0, 0, 5, 5)], 0, 10, one, 0, 100), (one, 5, 5, one, 5, 5)]
    got = [r[0] for r in spark.createDataFrame(data, schema).coalesce(1).select(segment_overlap()).collect()]
    assert got == [1.0, 0.5, pytest.approx(60 / 120), 0.0, 1.0, 0.0, None]


def test_tables_stay_in_step(spark):
    j = PairwiseOverlap(({"ro_min": 0.5},))
    assert rows(j.join(indexed(spark, A).repartition(5), indexed(spark, B), retain_index=True).select("index_a", "index_b")) == rows(j.join(indexed(spark, A), indexed(spark, B), retain_index=True).select("index_a", "index_b"))


def test_pairs_of_several_stages_are_not_moved_to_be_compared(spark):
    names = ["ro", "offset", "alleles", "filter", "xor", "exact", "own", "same size"]
    got = PairwiseOverlap(tuple(STAGES[n][0] for n in names)).join(indexed(spark, A), indexed(spark, B), retain_index=True)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    pairs = [(r.index_a, r.index_b) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == set().union(*(want(STAGES[n][1]) for n in names))


def test_repeated_indexes_and_unlike_stages_still_give_one_row_a_pair(spark):
    schema = "_index long, chrom string, pos long, `end` long, varlen long"
    a = spark.createDataFrame([(7, "c", 10, 20, 10), (7, "c", 12, 20, 8)], schema)
    b = spark.createDataFrame([(1, "c", 10, 20, 10), (2, "c", 4_000_000_000, 4_000_000_010, 10)], schema)
    join = PairwiseOverlap(({"ro_min": 0.5}, {"offset_max": 5}, {"size_ro_min": 1}), join_cols=("index_a", "index_b", ("pos_a", "p")), drop_default_join_cols=True)
    assert sorted(tuple(r) for r in join.join(a, b, retain_index=True).collect()) == [(7, 1, 10), (7, 2, 10)]
    assert sorted(tuple(r) for r in join.join(a.coalesce(1), b.coalesce(1)).collect()) == [(0, 0, 10), (0, 1, 10), (1, 0, 12)]
    part = F.array(F.struct("pos", "end", F.col("pos").alias("qry_pos"), F.col("end").alias("qry_end")))
    x, y = (t.withColumns({"seg": part, "qry_pos": F.col("pos"), "qry_end": F.col("end")}).where("pos != 12").coalesce(1) for t in (a, b))
    weights = WeightStrategy([("seg_ro", 2.0, None, 0.1)])
    got = PairwiseOverlap(({"ro_min": 0.5}, {"ro_min": 0.5, "seg_ro_min": 0.5}), weight_strategy=weights).join(x, y).collect()
    assert [(r.index_a, r.index_b, r.weight) for r in got] == [(0, 0, 2.0)]


def test_segments_that_form_one_run_are_compiled_and_measured_alike(spark):
    schema = "_index long, chrom string, pos long, `end` long, varlen long, seg array<struct<pos:bigint,end:bigint,qry_pos:bigint,qry_end:bigint>>, qry_pos long, qry_end long"
    r = random.Random(5)

    def data(n, whole):
        out = []
        for i in range(n):
            p, cuts = r.randrange(0, 60), sorted(r.randrange(0, 20) for _ in range(2))
            ends = [0, *cuts, 20]
            seg = [(p + x, p + y, 2 * x, 2 * y) for x, y in zip(ends, ends[1:], strict=False) if whole and x < y]
            if not whole:
                seg = r.choice([None, [], [(p, p, 3, 5)], [(p + 20, p, 0, 40)], [(p, p + 5, 0, 5), (p + 5, p + 20, 5, 40)], [(p, p + 5, 0, 5), (p + 7, p + 20, 9, 22)], [(p, None, 0, 5)], [None]])
            out.append((i, "c", p, p + 20, 20, seg, 0, r.choice([40, 44])))
        return out

    for whole_a, whole_b in ((True, True), (True, False), (False, True), (False, False)):
        a, b = (spark.createDataFrame(data(30, w), schema) for w in (whole_a, whole_b))
        got = PairwiseOverlap(({"ro_min": 0, "seg_ro_min": 0.4},), join_cols=("index_a", "index_b", "seg_ro"), drop_default_join_cols=True).join(a, b, retain_index=True)
        assert ("aggregate(seg_a" in got._jdf.queryExecution().optimizedPlan().toString()) != (whole_a and whole_b)
        x, y = (t.select(*[F.col(c).alias(f"{c}_{s}") for c in t.columns]) for t, s in ((a, "a"), (b, "b")))
        every = x.join(y, F.abs(F.col("pos_a") - F.col("pos_b")) < 20).select("_index_a", "_index_b", segment_overlap().alias("v")).where("v >= 0.4")
        wanted = {(i, j): v for i, j, v in every.collect()}
        assert {(i, j): v for i, j, v in got.collect()} == {k: pytest.approx(v, abs=1e-6) for k, v in wanted.items()} and wanted


def test_partners_are_counted_without_pairs_where_only_keys_count(spark):
    from strandlake.plans.interval_queries import QUERIES

    a, b = indexed(spark, A + A[:9]).withColumn("_index", F.col("_index") % 60), indexed(spark, B)
    for stages in ([{}], [{"match_ref": True, "match_vartype": True}], [{"match_filter_pass": True}], [{"match_filter_pass": True, "compat_filter_xor": True}], [{"offset_max": 0}], [{"ro_min": 0.5}], [{"size_ro_min": 1}], [{"join_predicates": ["pos_a < pos_b"]}], [{"ro_min": 0.5}, {"offset_max": 7}]):
        join = PairwiseOverlap(tuple(stages))
        n = {}
        for r in join.join(a, b, retain_index=True).collect():
            n[r.index_a] = n.get(r.index_a, 0) + 1
        assert dict(join.partners(a, b, retain_index=True).collect()) == n and n
    many = QUERIES["overlap_cross"](spark, "/root/testdata/sf0.001")
    assert "__salt" not in many._jdf.queryExecution().optimizedPlan().toString() and many.dtypes == [("index_a", "bigint"), ("n", "bigint")]


def test_weighted_multistage_query_moves_no_pairs(spark):
    from strandlake.plans.interval_queries import QUERIES

    got = QUERIES["overlap_weighted_multistage"](spark, "/root/testdata/sf0.001")
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    pairs = got.select("index_a", "index_b").collect()
    assert len(pairs) == len(set(pairs)) > 0


def test_near_stages_with_the_same_keys_find_their_pairs_in_one_join(spark):
    from strandlake.plans.interval_queries import QUERIES

    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")
    got = QUERIES["overlap_weighted_multistage"](spark, "/root/testdata/sf0.001")
    assert joins(got) == 1 and "side_a" not in "".join(got.inputFiles())
    typed = {"match_vartype": True, "offset_max": 30}, lambda a, b, m: a[7] == b[7] and m[2] <= 30
    typed_ro = {"match_vartype": True, "ro_min": 0.2}, lambda a, b, m: a[7] == b[7] and m[0] >= 0.2 - 1e-7
    for n, stages in ((1, [STAGES[s] for s in ("ro", "all", "exact", "prop")]), (1, [STAGES["exact"], STAGES["any"]]), (2, [STAGES["offset"], typed, typed_ro]), (2, [STAGES["prop"], STAGES["size"], STAGES["offset"]])):
        for args in ({}, {"bin_width": 1}):
            df = PairwiseOverlap(tuple(s for s, _ in stages), **args).join(indexed(spark, A), indexed(spark, B), retain_index=True)
            pairs = [(r.index_a, r.index_b) for r in df.collect()]
            assert joins(df) == n and len(pairs) == len(set(pairs)) and set(pairs) == set().union(*(want(rule) for _, rule in stages))


def test_near_stages_with_null_lengths_far_ends_and_empty_tables(spark):
    schema = "_index long, chrom string, pos long, `end` long, varlen long"
    a = spark.createDataFrame([(1, "c", 1, 9, None), (2, "c", 50, 60, 10), (3, "c", 100, 90, 0), (4, "c", 7, 5_000_000_000, 4)], schema)
    b = spark.createDataFrame([(1, "c", 1, 9, 8), (2, "c", 58, 68, 10), (3, "c", 100, 90, 0), (4, "c", 8, 12, 4)], schema)
    for force in (False, True):
        a = a.where("`end` < 1000") if force else a  # by end, the far one would overlap
        join = PairwiseOverlap(({"ro_min": 0.9}, {"size_ro_min": 0.8, "offset_max": 8}, {"offset_max": 0}), force_end_ro=force)
        assert {(r.index_a, r.index_b) for r in join.join(a, b, retain_index=True).collect()} == {(1, 1), (2, 2), (3, 3)}
        assert join.join(a.limit(0), b, retain_index=True).collect() == [] == join.join(a, b.limit(0), retain_index=True).collect()
