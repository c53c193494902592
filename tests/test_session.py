from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from strandlake.session import bounded, new_path, shared_dir, stage


def fake(master, folder=None):
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda key, default: folder))


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(fake(master))
        assert shared_dir(fake(master, "hdfs://x/y")) == "hdfs://x/y"


def test_nested_values_count_with_all_their_bytes(spark):
    df = spark.range(4).select("id", F.array_repeat(F.struct(F.lit("x" * 500).alias("t"), F.map_from_arrays(F.array(F.lit("k")), F.array(F.lit("v" * 400))).alias("m")), 3).alias("a"))
    assert bounded(df, 4, 4 * 3 * 1000 + 500) and not bounded(df, 4, 4 * 3 * 900) and not bounded(df, 3)
    assert bounded(df.limit(0), 0, 0) and bounded(spark.createDataFrame([(None, None)], "a string, b array<string>"), 1, 100)


def test_stored_tables_keep_their_schema(spark):
    df = spark.createDataFrame([], "a array<struct<b:int>>, `c.d` string")
    assert stage(df).schema == df.schema and new_path(spark, "x") != new_path(spark, "x")
