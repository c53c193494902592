import json

from strandlake.operators.drift import TargetField, canonical_fields, choose_target, ingest, promote, promote_all, schema_changes
from strandlake.operators.neighbours import with_next

from .conftest import rows

SCHEMA = "file_id long, pipeline string, file_no int, line_no int, id string, number string, type string, description string, change string, _rescued int"


def header(spark, *lines):
    return spark.createDataFrame([(*line, "clash", 1) for line in lines], SCHEMA)


def changes(df):
    return rows(schema_changes(df).select("file_id", "field_id", "change"))


def test_every_kind_of_change(spark):
    df = header(
        spark,
        (1, "p", 1, 1, "A", "1", "Integer", "a"), (1, "p", 1, 2, "B", "01", "Float", "b"), (1, "p", 1, 3, "C", "0", "Flag", "c"), (1, "p", 1, 4, "D", "2", "String", None),
        (7, "p", 9, 1, "A", " 1 ", "Float", "new text"), (7, "p", 9, 2, "BB", "2", "Int", "b"), (7, "p", 9, 3, "E", "x", "Text", None), (7, "p", 9, 5, "A", "5", "Flag", "late line"),
    )
    assert changes(df) == sorted([(7, "A", "type"), (7, "BB", "renamed"), (7, "BB", "number"), (7, "BB", "type"), (7, "C", "removed"), (7, "D", "removed"), (7, "E", "added")], key=repr)


def test_first_files_other_pipelines_repeats_and_nulls(spark):
    one = (1, "p", 1, 1, "A", None, None, None)
    same = (2, None, 5, 1, "A", ".", "String", None)
    df = header(spark, one, one, (3, "p", 2, 1, "A", ".", "Nonsense", "d"), same, (4, None, 6, 1, None, "1", "Flag", ""), (4, None, 6, 2, "A", ".", "String", "x"))
    assert changes(df) == []
    assert changes(df.limit(0)) == []


def test_neighbours_do_not_depend_on_the_step(spark):
    df = spark.createDataFrame([(k, n, i) for i, (k, n) in enumerate([("p", 5), ("p", 1), ("p", 5000), ("q", 1), (None, 3), ("p", 5), (None, 2)])], "k string, n int, f long")
    want = rows(with_next(df, ["k"], "n", "f", step=10**6))
    assert want == rows(with_next(df, ["k"], "n", "f", step=1)) == rows(with_next(df, ["k"], "n", "f", step=100))
    assert ("p", 1, 1, 0, True) in want and ("p", 5, 0, 5, False) in want and ("p", 5, 5, 2, False) in want


def test_chains_of_renames(spark):
    df = header(spark, *[(i, "p", i, 1, f"N{i}", "1", "Integer", "same") for i in range(1, 7)])
    assert {(r.field_id, r.canonical) for r in canonical_fields(df).collect()} == {(f"N{i}", "N6") for i in range(1, 7)}


def test_a_name_that_returns_takes_its_next_rename(spark):
    lines = [(1, 1, "X", "d"), (2, 2, "Y", "d"), (3, 3, "Y", "d"), (3, 3, "X", "e"), (4, 4, "Y", "d"), (4, 4, "Z", "e"), (5, 2000, "Y", "d"), (5, 2000, "W", "e")]
    for pipeline in ("p", None):
        df = header(spark, *[(f, pipeline, n, i, name, "1", "Integer", text) for i, (f, n, name, text) in enumerate(lines)])
        got = sorted((r.file_id, r.field_id, r.canonical) for r in canonical_fields(df).collect())
        assert got == [(1, "X", "Y"), (2, "Y", "Y"), (3, "X", "W"), (3, "Y", "Y"), (4, "Y", "Y"), (4, "Z", "W"), (5, "W", "W"), (5, "Y", "Y")]
        assert changes(df) == rows(spark.createDataFrame([(2, "Y", "renamed"), (3, "X", "added"), (4, "Z", "renamed"), (5, "W", "renamed")], "a long, b string, c string"))


def test_names_match_brute_force(spark):
    import random

    r, lines = random.Random(4), []
    for f in range(160):
        now = {i: f"d{r.choice([i, i, 7])}" for i in r.sample(range(8), r.randrange(2, 7))}
        lines += [(f, ("p", "q", None)[f % 3], f // 3 * 40, k, f"F{(i + r.choice([0, 0, 0, 1])) % 8}", "1", "Integer", d if r.random() < 0.9 else None) for k, (i, d) in enumerate(now.items())]
    declared, order = {}, {}
    for f, p, n, k, i, _, _, d in sorted(lines, key=lambda x: (x[0], x[3])):
        declared.setdefault(f, {}).setdefault(i, d)
        order.setdefault(p, set()).add((n, f))
    want = {}
    for files in order.values():
        files, renames = [f for _, f in sorted(files)], []
        for a, b in zip(files, files[1:]):
            gone = {}
            for i in sorted(declared[a].keys() - declared[b].keys(), reverse=True):
                gone[declared[a][i]] = i
            step = {}
            for i in sorted(declared[b].keys() - declared[a].keys(), reverse=True):
                if declared[b][i] is not None and declared[b][i] in gone:
                    step[gone[declared[b][i]]] = i
            renames.append(step)
        for at, f in enumerate(files):
            for i in declared[f]:
                name = i
                for step in renames[at:]:
                    name = step.get(name, name)
                want[f, i] = name
    assert {(r.file_id, r.field_id): r.canonical for r in canonical_fields(header(spark, *lines)).collect()} == want
    assert sum(k[1] != v for k, v in want.items()) > 50


def test_ingest_rescue_and_replay(spark):
    df = header(spark, (1, "p", 1, 1, "OLD", "1", "Integer", "d"), (1, "p", 1, 2, "L", "2", "Float", "l"), (2, "p", 2, 1, "NEW", "1", "Integer", "d"))
    records = spark.createDataFrame([(1, 0, "OLD=5;L=1.5,.;X=7;X=8;F", "z"), (2, 0, "NEW=no;L=1,b", "z"), (2, 1, ".", "z"), (2, 2, None, "z"), (9, 0, "NEW=4;;Y=a=b", "z")], "file_id long, vcf_rec long, info_text string, NEW string")
    target = [TargetField("NEW", "1", "Integer"), TargetField("L", "2", "Float"), TargetField("F", "0", "Flag")]
    table = ingest(records, df, target)
    got = {(r.file_id, r.vcf_rec): (r.NEW, r.L, r.F, json.loads(r["_rescued"] or "[]")) for r in table.collect()}
    assert got == {
        (1, 0): (5, [1.5, None], True, [{"field": "X", "value": "7"}, {"field": "X", "value": "8"}]),
        (2, 0): (None, None, None, [{"field": "NEW", "value": "no"}, {"field": "L", "value": "1,b"}]),
        (2, 1): (None, None, None, []),
        (2, 2): (None, None, None, []),
        (9, 0): (4, None, None, [{"field": "Y", "value": "a=b"}]),
    }
    promoted = {(r.file_id, r.vcf_rec): (r.X, json.loads(r["_rescued"] or "[]")) for r in promote(table, [TargetField("X", "1", "Integer")]).collect()}
    assert promoted[1, 0] == (7, [{"field": "X", "value": "8"}]) and promoted[2, 0][0] is None
    assert ingest(records.limit(0), df, target).collect() == []


def test_fields_beyond_the_columns_are_typed_as_well(spark):
    kinds = [("1", "Integer"), (".", "Float"), ("0", "Flag"), ("1", "String"), ("2", "Character")]
    df = header(spark, *[(1, "p", 1, i, f"F{i:02}", *kinds[i % 5], f"d{i}") for i in range(60)])
    texts = [";".join(f"F{i:02}" + ("" if i % 5 == 2 else "=7") for i in range(60)), "F58=a;F57=1;F55=x;F56=1.5,.;F55=3;F59=.;U=1;F00=no", "F50=4;F50=5;F50=x", None, "F52;F53=.;F51=a"]
    records = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "file_id long, vcf_rec long, info_text string")
    target = choose_target(df)
    table = promote_all(ingest(records, df, target), canonical_fields(df))
    assert len(target) == 48 and table.columns == ["file_id", "vcf_rec", *[t.name for t in target], "_promoted", "_rescued"]
    got = {r.vcf_rec: r for r in table.collect()}
    value = lambda x: next((v for v in (x.integers, x.floats, x.flag, x.strings) if v is not None), None)
    promoted = {k: {f: (x.type, value(x)) for f, x in (r["_promoted"] or {}).items()} for k, r in got.items()}
    rescued = {k: [(e["field"], e.get("value")) for e in json.loads(r["_rescued"] or "[]")] for k, r in got.items()}
    sevens = {"Integer": [7], "Float": [7.0], "Flag": True, "String": ["7"], "Character": ["7"]}
    assert promoted[0] == {f"F{i}": (kinds[i % 5][1], sevens[kinds[i % 5][1]]) for i in range(48, 60)} and rescued[0] == []
    assert promoted[1] == {"F58": ("String", ["a"]), "F56": ("Float", [1.5, None]), "F59": ("Character", None)}
    assert rescued[1] == [("F57", "1"), ("F55", "x"), ("F55", "3"), ("U", "1"), ("F00", "no")]
    assert promoted[2] == {"F50": ("Integer", [4])} and rescued[2] == [("F50", "5"), ("F50", "x")]
    assert promoted[3] == {} and rescued[3] == [] and got[3]["F00"] is None
    assert promoted[4] == {"F52": ("Flag", True), "F53": ("String", None)} and rescued[4] == [("F51", "a")]
    assert promote_all(ingest(records.limit(0), df, target), canonical_fields(df)).collect() == []


def test_values_are_typed_by_their_own_file_where_the_column_is_of_another_type(spark):
    df = header(spark, (1, "p", 1, 1, "A", "1", "Integer", "a"), (2, "p", 2, 1, "A", "1", "Integer", "a"), (3, "p", 3, 1, "A", "2", "Float", "a"))
    texts = [(3, 0, "A=1.5,2"), (3, 1, "A=7;A=1.5"), (3, 2, "A=.;A=1.5"), (1, 3, "A=1.5"), (9, 4, "A=1.5"), (3, 5, "A=x")]
    records = spark.createDataFrame(texts, "file_id long, vcf_rec long, info_text string")
    table = ingest(records, df, choose_target(df), fitted="_fitted")
    got = {r.vcf_rec: (r.A, r["_promoted"], r["_rescued"]) for r in promote_all(table, canonical_fields(df), "_fitted").collect()}
    a, promoted, rescued = got.pop(0)
    assert (a, promoted["A"].type, promoted["A"].floats, rescued) == (None, "Float", [1.5, 2.0], None)
    left = lambda v: f'[{{"field":"A","value":"{v}"}}]'
    assert got == {1: (7, None, left("1.5")), 2: (None, None, left("1.5")), 3: (None, None, left("1.5")), 4: (None, None, left("1.5")), 5: (None, None, left("x"))}
