import random
import re

from strandlake.operators.row_parse import IGNORED_ROW, RowField, RowSchema, classify_rows, digits_up_to, load_rows, rejected_rows
from strandlake.plans import record_queries

GOOD = 'c,q1;q2,BND,"a ""b"", c",12,id,A,"<X>",1.5,3,1'


def brute(x):
    """The stated rule, read character by character."""
    if x is None:
        return "columns"
    cells, i = [], 0
    while True:
        if x[i : i + 1] == '"':
            m = re.compile(r'"((?:[^"]|"")*)"').match(x, i)
            if not m or x[m.end() : m.end() + 1] not in ("", ","):
                return "quoting"
            cells.append(m[1].replace('""', '"'))
            i = m.end()
        else:
            j = x.find(",", i)
            j = len(x) if j < 0 else j
            if '"' in x[i:j]:
                return "quoting"
            cells.append(x[i:j])
            i = j
        if i >= len(x):
            break
        i += 1
    if len(cells) != 11:
        return "columns"
    number = lambda t, top: re.fullmatch("[0-9]+", t) and int(t) <= top
    good = all(cells[k] for k in (0, 3, 6, 7)) and cells[2] in ("", "BND", "TRA") and re.fullmatch(r"([0-9]+(\.[0-9]+)?)?", cells[8])
    good = good and number(cells[4], 2**63 - 1) and number(cells[9], 2**63 - 1) and number(cells[10], 2**31 - 1)
    return None if good else "value"


def test_mutated_rows_match_brute_force(spark):
    r, cases = random.Random(1), [GOOD, None, "", '"', ",", '""', "a" * 300_000, "," * 300_000, '"' + '""' * 50_000 + '",,,x,1,,A,B,,0,1', GOOD + "\n", GOOD + ","]
    for top in (2**63 - 1, 2**63, 2**31 - 1, 2**31, "0007", "-1", "", "1.0", "٣"):
        cases += [f"c,,,x,{top},,A,B,,0,1", f'c,,,x,1,,A,B,,0,"{top}"', f"c,,,x,1,,A,B,{top},0,1"]
    for _ in range(3000):
        t = list(GOOD)
        for _ in range(r.randrange(1, 4)):
            k = r.randrange(len(t))
            t[k : k + r.randrange(2)] = r.choice(['"', ",", "x", "1", "", "\n", '""'])
        cases.append("".join(t))
    got = classify_rows(spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, line string"), "line", IGNORED_ROW).collect()
    assert [(g.i, g.reject_reason) for g in sorted(got)] == [(i, brute(c)) for i, c in enumerate(cases)]


def test_first_broken_field(spark):
    lines = [GOOD.replace("BND", "XXX"), GOOD.replace(",12,", ",x,"), GOOD + ",more", "c"]
    got = rejected_rows(spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1), "line", IGNORED_ROW).collect()
    assert [(g.reject_reason, g.reject_field) for g in got] == [("value", "vartype"), ("value", "vcf_pos"), ("columns", None), ("columns", "filter")]


def test_the_query_of_rejected_rows_names_the_broken_field(spark, tmp_path):
    lines = [GOOD, GOOD.replace(",12,", ",x,"), GOOD + ",more", None, GOOD.replace("BND", 'B"D')]
    spark.createDataFrame(list(enumerate(lines)), "line_id long, raw_line string").write.parquet(f"{tmp_path}/ignored_line.parquet")
    got = record_queries.QUERIES["p7_rejected"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, "value", "vcf_pos"), (2, "columns", None), (3, "columns", "chrom"), (4, "quoting", "vartype")]


def test_loaded_values_and_clashing_columns(spark):
    df = spark.createDataFrame([(GOOD, "x", "y"), (GOOD, "x", "y"), ("bad", "x", "y")], "line string, __cells string, chrom string")
    got = load_rows(df, "line", IGNORED_ROW).collect()
    assert [tuple(r) for r in got] == [("c", ["q1", "q2"], "BND", 'a "b", c', 12, "id", "A", "<X>", 1.5, 3, 1)] * 2
    assert load_rows(df.limit(0), "line", IGNORED_ROW).collect() == []


def test_an_empty_first_field_keeps_its_place(spark):
    schema = RowSchema((RowField("a"), RowField("b"), RowField("c", "int", "[0-9]+")))
    lines = [",x,7", ',"",', "a,b,1", ",,", '"",x,', "\"q,\"\"\",,2"]
    got = load_rows(spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1), "line", schema).collect()
    assert [tuple(r) for r in got] == [(None, "x", 7), (None, None, None), ("a", "b", 1), (None, None, None), (None, "x", None), ('q,"', None, 2)]


def test_digit_patterns():
    for top in (0, 7, 10, 99, 100, 2**31 - 1):
        p = re.compile(digits_up_to(top) + r"\Z")
        for n in {0, 1, 5, 7, 8, 9, 10, 11, 99, 100, 101, top - 1, top, top + 1, top * 10}:
            if n >= 0:
                assert bool(p.match(str(n))) == bool(p.match("00" + str(n))) == (n <= top), (top, n)
        assert not p.match("") and not p.match("-1")
