"""Fixed schemas: the variant table, its column order by type, and the pairwise tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VARIANT = T.StructType(
    [
        T.StructField("chrom", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("vartype", T.StringType()),
        T.StructField("varlen", T.LongType()),
        T.StructField("ref", T.StringType()),
        T.StructField("alt", T.StringType()),
        T.StructField("filter", T.ArrayType(T.StringType())),
        T.StructField("seq", T.StringType()),
    ]
)

# The columns of each variant type, in their standard order.
STANDARD_FIELDS: dict[str, tuple[str, ...]] = {
    "snv": ("chrom", "pos", "end", "id", "vartype", "ref", "alt", "filter"),
    "insdel": ("chrom", "pos", "end", "id", "vartype", "varlen", "filter", "seq"),
    "inv": ("chrom", "pos", "end", "id", "vartype", "varlen", "filter", "seq"),
    "dup": ("chrom", "pos", "end", "id", "vartype", "varlen", "filter", "seq"),
    "sub": ("chrom", "pos", "end", "id", "vartype", "varlen", "ref", "alt", "filter"),
    "cpx": ("chrom", "pos", "end", "id", "vartype", "varlen", "filter"),
}


def check_columns(df: DataFrame, required: set[str] | frozenset[str], what: str = "table") -> None:
    missing = sorted(required - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks required columns: {', '.join(missing)}")


def _castable(have: T.DataType, want: T.DataType) -> bool:
    """Whether a cast can be meant: numbers and text to numbers, anything atomic to text."""
    if have == want or isinstance(have, T.NullType):
        return True
    if isinstance(want, T.ArrayType):
        return isinstance(have, T.ArrayType) and _castable(have.elementType, want.elementType)
    if isinstance(want, T.LongType):
        return isinstance(have, (T.NumericType, T.StringType))
    return isinstance(want, T.StringType) and not isinstance(have, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def to_variant(df: DataFrame) -> DataFrame:
    """Casts the known columns that ``df`` has to the variant schema; others stay.

    A column whose type cannot be cast is a ValueError; a text that is no number fails when read.
    """
    known, columns = {f.name: f.dataType for f in VARIANT.fields}, []
    for f in df.schema.fields:
        want = known.get(f.name)
        if want is None:
            columns.append(F.col(f"`{f.name}`"))
            continue
        if not _castable(f.dataType, want):
            raise ValueError(f"column {f.name} of type {f.dataType.simpleString()} cannot be read as {want.simpleString()}")
        columns.append(F.col(f"`{f.name}`").cast(want).alias(f.name))
    return df.select(*columns)
