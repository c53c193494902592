"""Session helpers: shared storage for intermediate tables and size-checked broadcasts.

Nothing here changes results.  ``stage`` cuts lineage with a Parquet table in the folder that
``spark.checkpoint.dir`` names, so a lost executor never loses an intermediate result.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest number of rows that any operator of this package broadcasts, and the bytes they may have.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20

_STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session: that of ``spark.checkpoint.dir``, else the checkpoint folder set.

    A session that runs in one process may have none: it gets a folder of its own.  On a cluster, where
    executors could not read each other's parts in such a folder, a missing one is a RuntimeError.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="strandlake-")
        sc.setCheckpointDir(configured)
        _STAGED.append(configured)
    return configured


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is dropped when the session ends."""
    path = f"{shared_dir(spark).rstrip('/')}/strandlake/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{name}"
    _STAGED.append(path)
    return path


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later uses do not recompute it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Drops every stored table of the session; results that are not written yet are lost with them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _STAGED:
        p = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        p.getFileSystem(conf).delete(p, True)


@atexit.register
def _drop_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or not _STAGED:
        return
    try:
        drop_staged(spark)
    except Exception:  # the JVM may be gone; the folder is the cluster's to clean then
        pass


def _width(value: Column, kind: T.DataType) -> Column:
    """The bytes of a value: of text and binaries their length, of nested values the sum of their parts."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        own = F.octet_length(value)
    elif isinstance(kind, T.StructType):
        own = sum((_width(value.getField(f.name), f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    elif isinstance(kind, T.ArrayType):
        own = F.aggregate(value, F.lit(8).cast("long"), lambda s, x: s + _width(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        return _width(F.map_entries(value), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
    else:
        return F.lit(16).cast("long")
    return F.coalesce(own.cast("long"), F.lit(0).cast("long"))


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is proven small: at most ``max_rows`` rows and ``max_bytes`` bytes of values.

    Rows are counted where they are, by partial aggregation; no rows are moved for the proof.
    """
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0).cast("long"))
    n, b = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= max_rows and b <= max_bytes


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is proven small, else as it is (a shuffle join then)."""
    return F.broadcast(df) if bounded(df, max_rows, max_bytes) else df
