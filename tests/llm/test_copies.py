import random
import re

import pytest

from strandlake.llm.copies import CopyGroups, canonical_text
from strandlake.llm.hot import attach, hot_keys

from ..conftest import rows

SCHEMA = "call_id long, src string, pos long, ref string, alt string, k1 string, n int"


def canon(x):
    parts = [re.sub(r"[\W_]+", "", p).upper() for p in re.split("[,;/|]", x)]
    return ",".join(sorted(p for p in parts if p))


def brute(data):
    first, out, n = {}, [], {}
    for i, s, p, r, a, *_ in sorted(data, key=lambda x: x[0]):
        if None in (s, p, r, a):
            n[i] = 1
            continue
        key = (s, p, canon(r), canon(a))
        if key in first:
            out.append((first[key], i))
        f = first.setdefault(key, i)
        n[f] = n.get(f, 0) + 1
    return sorted(out, key=repr), sorted(n.items(), key=repr)


@pytest.mark.parametrize(("share", "least"), [(1 / 2000, 4096), (0.05, 5), (0.5, 1)])
def test_hot_or_not_the_copies_are_the_same(spark, share, least):
    r, data = random.Random(4), []
    for i in range(900):
        alt = "a,c" if i % 3 == 0 else r.choice(["A", "A, C", "AC", "c;A", "(g)", "", " . ", "t\xa0|G|", None, "ß", "SS"])
        data.append((i * 3, "s" if i % 3 == 0 else r.choice(["s", "u", None]), 5, "a" if i % 3 == 0 else r.choice(["A", " a'", "t", None]), alt, "clash", 1))
    r.shuffle(data)
    groups = CopyGroups(spark.createDataFrame(data, SCHEMA).repartition(6), "call_id", ["src", "pos"], ["ref", "alt"], share, least)
    copies, reps = brute(data)
    assert rows(groups.further_copies()) == copies
    assert rows(groups.representatives()) == reps


def test_empty(spark):
    groups = CopyGroups(spark.createDataFrame([], SCHEMA), "call_id", ["src"], ["ref"])
    assert rows(groups.further_copies()) == rows(groups.representatives()) == []


def test_canonical_text(spark):
    texts = ["A,C", "c / a", "AC", "a,,c;", "'A'\t", "", ",;", "<DEL>", "é-x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [r[0] for r in df.select(canonical_text(df.t)).collect()] == ["A,C", "A,C", "AC", "A,C", "A", "", "", "DEL", "ÉX", None]


def test_hot_keys_are_exact(spark):
    data = [(1, 1)] * 300 + [(1, 2)] * 99 + [(2, 1)] * 100 + [(i, i) for i in range(10, 511)]
    df = spark.createDataFrame(data, "k1 long, k2 long").repartition(9)
    assert rows(hot_keys(df, len(data), 100)) == [(1, 1, 300), (2, 1, 100)]


def test_attach_by_both_ways(spark, monkeypatch):
    left = spark.createDataFrame([(1, i) for i in range(5000)] + [(k, k) for k in range(2, 50)], "k long, v long")
    right = spark.createDataFrame([(1, "a", 5000)] + [(k, "b", 1) for k in range(2, 60)], "k long, g string, n long")
    want = rows(attach(left, right, "k", "n", 5048))
    monkeypatch.setattr("strandlake.llm.hot.bounded", lambda *_: False)
    assert rows(attach(left, right, "k", "n", 5048)) == want and len(want) == 5048
