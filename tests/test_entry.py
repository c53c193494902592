import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

ROOT, TABLES = Path(__file__).parents[1], Path(os.environ.get("TEST_TABLES", "/root/testdata/sf0.001"))
SAMPLE = ["p1_found", "p2_found", "p3_found", "p7_found", "p7_loaded", "interval_join_distance", "interval_as_bool_negate", "merge_depth_distance", "overlap_weighted_multistage", "kmer_minimizer", "vcf_alleles"]


def entry():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    return __spark_entry__


def test_every_sql_has_a_query():
    e = entry()
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50


def test_core_does_not_need_the_optional_subpackage():
    code = "import sys; sys.modules['strandlake.llm'] = None; import __spark_entry__ as e; print(sorted(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    assert "p1_found" in out and "p5_found" not in out


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", SAMPLE)
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in TABLES.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    e = entry()
    df, rel = e.queries()[name](spark, str(TABLES)), con.sql(e.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    place = [rel.columns.index(c) for c in columns]
    tidy = lambda row: tuple(float(f"{v:.7g}") if isinstance(v, float) else v for v in row)
    assert Counter(tidy(r) for r in df.select(*columns).collect()) == Counter(tidy([r[i] for i in place]) for r in rel.fetchall())
