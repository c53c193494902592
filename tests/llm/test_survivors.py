import random

import pytest

from strandlake.llm.survivors import TruthDiscovery, micros_of

from ..conftest import rows

RECORDS = "source string, item long, at timestamp_ntz, id string, n long, tags array<string>, code int, weight string"


def make(spark, groups, records, trust, **args):
    g = spark.createDataFrame(groups, "group long, source string, item long, code string")
    r = spark.createDataFrame(records, RECORDS)
    t = spark.createDataFrame(trust, "source string, rank int")
    return TruthDiscovery(g, r, t, {"id": "string", "n": "bigint", "tags": "array<string>"}, micros_of("at"), **args), g


def data():
    from datetime import datetime, timedelta

    r, records, groups = random.Random(9), [], []
    for s in "abcdef":
        for i in range(40):
            for _ in range(1 + (r.random() < 0.1)):
                good = s in "abcd" or r.random() < 0.3
                records.append((s, i, datetime(2024, 1, 1) + timedelta(hours=r.randrange(3)), r.choice([f"V{i}", f"v {i}"]) if good else r.choice([None, " ", ".", "wrong"]), i if good else r.choice([None, -1]), r.choice([None, [], ["q"]]), 0, ""))
    for i in range(40):
        for s in r.sample("abcdef", r.randrange(1, 7)):
            groups += [(i, s, i, "")] * r.choice([1, 1, 2])
    groups += [(900, "a", 777, ""), (901, None, 1, ""), (None, "a", 1, ""), (902, "zz", 1, "")]
    return groups, records, [("a", 3), ("b", 1), ("c", 1), ("c", 5)]


def base(groups, records, trust):
    """The rule for the base record, straight from its words."""
    rank, out = {}, {}
    for s, k in trust:
        rank[s] = min(k, rank.get(s, k))
    for g, s, i, _ in groups:
        for rs, ri, at, ident, n, tags, *_ in records:
            if g is not None and (rs, ri) == (s, i):
                gone = (ident is None or ident.strip() in ("", ".")) + (n is None) + (tags is None)
                key = (gone, -at.timestamp(), rank.get(s, 10**9), s, i)
                out[g] = min(out.get(g, key), key)
    return sorted((g, k[3], k[4]) for g, k in out.items())


@pytest.mark.parametrize("args", [{}, {"row_claims": 2}, {"max_sources": 3}])
def test_all_ways_agree(spark, args):
    groups, records, trust = data()
    truth, g = make(spark, groups, records, trust, **args)
    got = truth.decided().collect()
    assert sorted((r.group, r.base.source, r.base.item) for r in got) == base(groups, records, trust)
    plain = {r.group: r.win for r in make(spark, groups, records, trust)[0].decided().collect()}
    assert {r.group: r.win for r in got} == plain
    best = {r.group: (r.id, r.n) for r in truth.survivors(g).collect()}
    right = sum(v[1] == k for k, v in best.items())
    assert right >= 0.9 * len(best)


def test_reliability_beats_numbers(spark):
    from datetime import datetime

    at = datetime(2024, 1, 1)
    records = [(s, i, at, f"V{i}", i, [], 0, "") for s in "ab" for i in range(30)] + [(s, i, at, f"{s}{i}", -i, [], 0, "") for s in "xyz" for i in range(30)]
    groups = [(i, s, i, "") for i in range(25) for s in "abx"] + [(i, s, i, "") for i in range(25) for s in ("a", "b", "yz"[i % 2])]
    groups += [(100, "a", 29, ""), (100, "x", 29, "")]
    truth, g = make(spark, groups, records, [])
    assert {r.group: r.id for r in truth.survivors(g).collect()}[100] == "V29"
    assert truth.converged and truth.weights[0] > truth.weights[2]


def test_nothing(spark):
    for groups, records in (([], []), ([(1, "a", 1, "")], [])):
        truth, g = make(spark, groups, records, [])
        assert rows(truth.decided()) == [] and rows(truth.survivors(g)) == []
