import random

from strandlake.operators.periods import merge_periods

from .conftest import rows

SCHEMA = "track string, chrom string, pos long, `end` long, tile long, s string, w string"


def brute(data):
    groups, out = {}, []
    for t, c, p, e, *_ in data:
        if None not in (t, c, p, e) and e >= p:
            groups.setdefault((t, c), []).append((p, e))
    for key, iv in groups.items():
        merged = []
        for p, e in sorted(iv):
            if merged and p <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([p, e])
        out += [("period", *key, *m) for m in merged] + [("gap", *key, a[1], b[0]) for a, b in zip(merged, merged[1:], strict=False)]
    return sorted(out, key=repr)


def test_matches_brute_force_at_every_tile(spark):
    r = random.Random(3)
    data = []
    for _ in range(600):
        p = r.randrange(-500, 3000)
        data.append((r.choice(["t", "u", None]), r.choice("xy"), p, p + r.choice([0, 0, 1, 2, 5, 40, -3, 700]), 1, "q", None))
    data += [("t", "x", 10**12, 10**12 + 5, 0, "", ""), ("t", "x", None, 5, 0, "", ""), ("t", None, 1, 5, 0, "", ""), ("v", "x", 7, 7, 0, "", "")] + data[:50]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    for tile in (None, 1, 7, 100, 10**6):
        assert rows(merge_periods(df, ["track", "chrom"], tile=tile)) == brute(data)


def test_touching_empty_and_nested(spark):
    df = lambda *iv: spark.createDataFrame([("t", "x", a, b, 0, "", "") for a, b in iv], SCHEMA)
    got = lambda *iv: [tuple(r)[:1] + tuple(r)[3:] for r in rows(merge_periods(df(*iv), ["track", "chrom"]))]
    assert got((1, 3), (3, 5)) == [("period", 1, 5)]
    assert got((1, 3), (4, 5)) == [("gap", 3, 4), ("period", 1, 3), ("period", 4, 5)]
    assert got((3, 3), (3, 3)) == [("period", 3, 3)]
    assert got((1, 9), (2, 3), (9, 9)) == [("period", 1, 9)]


def test_nothing(spark):
    assert rows(merge_periods(spark.createDataFrame([], SCHEMA), ["track", "chrom"])) == []
    assert rows(merge_periods(spark.createDataFrame([("t", "x", 5, 4, 0, "", "")], SCHEMA), ["track", "chrom"])) == []
