import random

import pytest

from strandlake.llm.components import connected_groups

SCHEMA = "a long, b long, id string, group_id int"


def brute(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize(("limit", "joined", "max_set"), [(10**6, True, 4096), (60, True, 4096), (60, False, 4096), (60, True, 1)])
def test_matches_brute_force_at_every_bound(spark, limit, joined, max_set, monkeypatch):
    if not joined:
        for name in ("components", "hot"):
            monkeypatch.setattr(f"strandlake.llm.{name}.bounded", lambda *_: False)
    r = random.Random(limit)
    links = [(r.randrange(300) * 7 - 100, r.randrange(300) * 7 - 100) for _ in range(250)]
    links += [(10**12 + i, 10**12 + i + 1) for i in range(120)]  # a chain
    links += [(-(10**15), -i) for i in range(1, 100)]  # a star
    links += [(None, 5), (5, None), (None, None), (3333333, 3333333)] + links[:40] + [(b, a) for a, b in links[:40]]
    r.shuffle(links)
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in links], SCHEMA).repartition(4)
    assert {x.id: x.group_id for x in connected_groups(df, "a", "b", task_links=limit, max_set=max_set).collect()} == brute(links)


def test_empty(spark):
    assert connected_groups(spark.createDataFrame([], SCHEMA), "a", "b").collect() == []
    assert connected_groups(spark.createDataFrame([(None, 1, "", 0)], SCHEMA), "a", "b").collect() == []
