import math

from strandlake.operators.dense_aggregate import dense_key_aggregate, heavy_keys

SCHEMA = "k string, v long, w double, n_rows int, k0 string"
ROWS = [("a", 1, 1.5, 9, "x")] * 50 + [("b", None, None, 9, "x"), ("b", 2**62, 2.5, 9, "x"), (None, -7, 0.5, 9, "x"), ("", 3, -1.0, 9, "x"), ("ü", -(2**40), 4.0, 9, None)] * 3


def brute(data):
    out = {}
    for k, v, w, *_ in data:
        e = out.setdefault(k, [0, [], []])
        e[0] += 1
        if v is not None:
            e[1].append(v)
        if w is not None:
            e[2].append(w)
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    stat = lambda x, s: (len(x), s(sum(x)) if x else None, min(x, default=None), max(x, default=None))
    return {k: (n, *stat(v, wrap), *stat(w, float)) for k, (n, v, w) in out.items()}


def test_matches_brute_force_whatever_the_block(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(7)
    for args in ({}, {"task_entries": 2, "fan_in": 2}, {"task_entries": 1}, {"fan_in": 1}):
        got = {r[0]: tuple(r)[1:] for r in dense_key_aggregate(df, "k", ["v", "w"], **args).collect()}
        assert got == brute(ROWS)


def test_more_keys_than_a_split_holds(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for args in ({"split_keys": 0}, {"split_keys": 2, "task_entries": 2}, {"split_key_bytes": 1, "fan_in": 2}):
        got = {r[0]: tuple(r)[1:] for r in dense_key_aggregate(df, "k", ["v", "w"], **args).collect()}
        assert got == brute(ROWS)
    many = [(f"k{i % 5000}", i, None, 0, "") for i in range(12_000)]
    got = {r[0]: tuple(r)[1:] for r in dense_key_aggregate(spark.createDataFrame(many, SCHEMA), "k", ["v", "w"], split_keys=700, task_entries=900).collect()}
    assert got == brute(many)


def test_empty_and_all_null(spark):
    assert dense_key_aggregate(spark.createDataFrame([], SCHEMA), "k", ["v"]).collect() == []
    assert [tuple(r) for r in dense_key_aggregate(spark.createDataFrame([(None, None, None, 1, "")] * 3, SCHEMA), "k", ["v"]).collect()] == [(None, 3, 0, None, None, None)]
    assert heavy_keys(spark.createDataFrame([], SCHEMA), "k", 0.05).collect() == []


def test_nan_spreads(spark):
    df = spark.createDataFrame([("a", 1, math.nan, 1, ""), ("a", 1, 2.0, 1, ""), ("a", 1, 1.0, 1, "")], SCHEMA).repartition(3)
    for args in ({}, {"split_keys": 0}, {"fan_in": 1}):
        got = dense_key_aggregate(df, "k", ["w"], **args).first()
        assert got["w_n"] == 3 and math.isnan(got["w_sum"]) and math.isnan(got["w_min"]) and math.isnan(got["w_max"])


def test_heavy_keys_is_strict_and_counts_nulls_as_rows(spark):
    data = [("a",)] * 5 + [("b",)] * 6 + [(None,)] * 89
    assert [r.k for r in heavy_keys(spark.createDataFrame(data, "k string"), "k", 0.05).collect()] == ["b"]
