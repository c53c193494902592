import math
import random

import pytest

from strandlake.coords import CoordCol, get_coord_cols, make_unique, rename_collisions, standardize
from strandlake.operators.annotate import as_bool, as_proportion
from strandlake.operators.depth import melt_depth, merge_depth
from strandlake.operators.indexing import with_index
from strandlake.operators.interval_join import pairwise_join, pairwise_join_iter

from .conftest import rows

IV = "_index long, chrom string, pos long, `end` long"


def random_intervals(n, seed):
    r, out = random.Random(seed), []
    for i in range(n):
        p = r.randrange(0, 4000)
        out.append((i, r.choice("xy"), p, p + r.choice([0, 1, 5, 30, 400, 3000])))
    return out


A, B = random_intervals(90, 1), random_intervals(110, 2)


def near(a, b, d):
    return a[1] == b[1] and b[2] - d <= a[3] and b[3] + d >= a[2]


@pytest.mark.parametrize("d", [0, 37, -5])
@pytest.mark.parametrize("width", [None, 1, 1000])
def test_join_matches_brute_force(spark, d, width):
    got = rows(pairwise_join(spark.createDataFrame(A, IV), spark.createDataFrame(B, IV), d, bin_width=width))
    want = [(a[0], b[0], a[1], *sorted((max(a[2], b[2]), min(a[3], b[3]))), max(a[2], b[2]) - min(a[3], b[3])) for a in A for b in B if near(a, b, d)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize(("a", "b", "d", "n"), [((100, 200), (200, 300), 0, 1), ((100, 200), (250, 300), 49, 0), ((100, 200), (250, 300), 50, 1), ((100, 200), (150, 300), -51, 0), ((100, 200), (150, 300), -50, 1)])
def test_join_edges(spark, a, b, d, n):
    assert pairwise_join(spark.createDataFrame([(0, "c", *a)], IV), spark.createDataFrame([(0, "c", *b)], IV), d).count() == n


def test_query_coordinates_and_iterator(spark):
    q = spark.createDataFrame([(0, "c", 5, 9, "clash")], "_index long, qry_id string, qry_pos long, qry_end long, pos_b string")
    b = spark.createDataFrame([(3, "c", 1, 6)], IV)
    assert rows(pairwise_join(q, b, 0, "qry")) == [(0, 3, "c", 5, 6, -1)]
    assert [rows(x) for x in pairwise_join_iter(spark.createDataFrame(A, IV).where("false"), b)] == [[]]
    assert len(list(pairwise_join_iter(spark.createDataFrame(A, IV), b))) == 2


@pytest.mark.parametrize("d", [0, 20, -3])
def test_as_bool(spark, d):
    a, b = [*A, (900, "x", None, 5), (901, None, 1, 5)], B[:15]
    for negate in (False, True):
        got = rows(as_bool(spark.createDataFrame(a, IV), spark.createDataFrame(b, IV), "hit", d, negate))
        assert got == sorted(((x[0], any(None not in x and near(x, y, d) for y in b) != negate) for x in a), key=repr)
    with pytest.raises(ValueError):
        as_bool(spark.createDataFrame(a, IV), spark.createDataFrame(b, IV), " ")


def test_as_proportion(spark):
    a, b = [*A, (900, "x", None, 5)], B[:20]
    got = {r[0]: r[1] for r in as_proportion(spark.createDataFrame(a, IV), spark.createDataFrame(b, IV), "share").collect()}
    for i, c, p, e in a:
        if p is None:
            assert got[i] is None
        elif p == e:
            assert math.isnan(got[i])
        else:
            covered = {x for y in b if y[1] == c for x in range(max(p, y[2]), min(e, y[3]))}
            assert got[i] == pytest.approx(len(covered) / (e - p))


def sweep(data, d=0):
    melted, merged = [], []
    for c in sorted({x[1] for x in data}):
        events = sorted([(x[2], -1, 1) for x in data if x[1] == c] + [(x[3] + d, 0, 0) for x in data if x[1] == c] + [(x[3] + d, 1, -1) for x in data if x[1] == c])
        depth, run = 0, None
        for loc, _, k in events:
            run = run or [loc, 0]
            depth += k
            melted.append((c, loc, depth))
            run[1] = max(run[1], depth)
            if depth == 0 and k == -1:
                merged.append((c, run[0], loc - d, run[1]))
                run = None
    return melted, merged


@pytest.mark.parametrize("d", [0, 1, 100])
def test_depth(spark, d):
    df = spark.createDataFrame([*A[:40], (99, "x", None, 4), (98, None, 1, 4)], IV)
    assert rows(merge_depth(df, d)) == sorted(sweep(A[:40], d)[1], key=repr)
    assert rows(melt_depth(df)) == sorted(sweep(A[:40])[0], key=repr)


def test_depth_edges(spark):
    df = lambda *iv: spark.createDataFrame([(0, "c", a, b) for a, b in iv], IV)
    assert rows(merge_depth(df((100, 200), (200, 300)))) == [("c", 100, 300, 2)]
    assert rows(merge_depth(df((100, 200), (250, 300)), 50)) == [("c", 100, 300, 2)]
    assert rows(merge_depth(df((100, 200), (250, 300)), 49)) == [("c", 100, 200, 1), ("c", 250, 300, 1)]
    assert rows(melt_depth(df((100, 200)))) == [("c", 100, 1), ("c", 200, 0), ("c", 200, 1)]
    assert merge_depth(df((1, 2)), col_max_depth=None).columns == ["chrom", "pos", "end"]
    assert rows(merge_depth(df((1, 2)).limit(0))) == []
    with pytest.raises(ValueError):
        merge_depth(df((1, 2)), col_max_depth="pos")
    with pytest.raises(AssertionError):
        melt_depth(df((1, 2)), col_loc="end")


def test_index(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "a long, b long").repartition(6)
    got = with_index(df, ["a", "b"]).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r["_index"])] == sorted((i % 7, i) for i in range(500))
    assert sorted(r["_index"] for r in with_index(df).collect()) == list(range(500))
    assert with_index(df.limit(0)).collect() == []
    assert with_index(df.withColumnRenamed("b", "_index")).count() == 500


def test_names():
    assert tuple(get_coord_cols("qry")) == ("qry_id", "qry_pos", "qry_end") and tuple(get_coord_cols(None)) == ("chrom", "pos", "end")
    assert get_coord_cols(CoordCol("a", "b", "c")).suffixed("_a").pos == "b_a"
    for bad in ("x", ["a", "b"], ("a", "a", "b"), ("", "b", "c")):
        with pytest.raises(ValueError):
            get_coord_cols(bad)
    assert make_unique("a", ["a", "a_1"]) == "a_2" and rename_collisions(["a", "a", "b", "a"]) == ["a", "a.1", "b", "a.2"]
    assert standardize(" #Chrom Name ") == "chrom_name"
