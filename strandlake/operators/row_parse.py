"""Loading delimited rows of which some fail to parse.

Method: one anchored regular expression is generated from the schema for the whole row; rows that
match it are valid.  The others pass through field-prefix patterns, one field longer each time, and
the first prefix that does not match names the broken field.  What the row is like from that field on
gives the reason.  All of it stays in the JVM, and quantifiers are possessive, so a row of any length
is read once per pattern, without backtracking or recursion.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A field as it may stand in a row, whatever its value: quoted (quotes inside are doubled) or bare.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_BARE = r'[^",]*+'
_ANY = f"(?:{_QUOTED}|{_BARE})"


def digits_up_to(limit: int) -> str:
    """A pattern for a run of digits whose value is not above ``limit``; leading zeros are allowed."""
    top = str(limit)
    parts = [rf"[0-9]{{1,{len(top) - 1}}}(?![0-9])"] if len(top) > 1 else []
    for i, d in enumerate(top):
        if d != "0":
            parts.append(f"{top[:i]}[0-{int(d) - 1}]" + f"[0-9]{{{len(top) - i - 1}}}(?![0-9])")
    return f"(?=[0-9])0*+(?:{'|'.join([*parts, top + '(?![0-9])'])}|(?![0-9]))"


LONG, INT = digits_up_to(2**63 - 1), digits_up_to(2**31 - 1)
DECIMAL = r"[0-9]++(?:\.[0-9]++)?+"


@dataclass(frozen=True)
class RowField:
    """A column of the row.

    ``pattern`` is the pattern of its value (None: any text); ``empty`` says whether it may be empty
    (then its value is null); ``kind`` is the Spark type to read it as, or ``array:X`` for a list of
    strings with separator X.
    """

    name: str
    kind: str = "string"
    pattern: str | None = None
    empty: bool = True

    def regex(self) -> str:
        """The field with a valid value, quoted or bare, up to the next separator or the row's end."""
        if self.pattern is not None:
            body = f'(?:"(?:{self.pattern})"|(?:{self.pattern}))'
            if self.empty:
                body = f'(?:{body}|""|)'
        elif self.empty:
            body = _ANY
        else:
            body = rf'(?:"(?:[^"]|"")[^"]*+(?:""[^"]*+)*+"|[^",]++)'
        return rf"{body}(?=,|\z)"


@dataclass(frozen=True)
class RowSchema:
    fields: tuple[RowField, ...]

    def whole(self) -> str:
        return r"\A" + ",".join(f.regex() for f in self.fields) + r"\z"

    def prefix(self, n: int) -> str:
        """Matches rows whose first ``n`` fields are valid."""
        return r"\A" + ",".join(f.regex() for f in self.fields[:n])

    def structure(self, n: int | None = None) -> str:
        """Matches rows with correct quoting, of any number of fields or of ``n``."""
        more = "*+" if n is None else f"{{{n - 1}}}+"
        return rf"\A{_ANY}(?:,{_ANY}){more}\z"


def classify_rows(df: DataFrame, text: str, schema: RowSchema) -> DataFrame:
    """``df`` with ``reject_reason`` and ``reject_field`` added; both are null for a valid row.

    The reason is the first that holds of ``quoting``, ``columns``, ``value``; ``reject_field`` is
    the name of the first field at which the row stops being valid (null if the row has all its
    fields and more after them).

    Defined cases: a null row has no field, so its reason is ``columns``, at the first field; an
    empty row has one empty field; line ends belong to the field they stand in; repeated rows are
    judged each on its own; an empty table stays empty; columns of the same names as the two added
    ones are replaced, all other columns stay.
    """
    row, n = F.col(f"`{text}`"), len(schema.fields)
    # the number of the first field whose prefix fails; n where all fields are there and valid
    broken: Column = F.when(row.isNull(), 0).when(row.rlike(schema.whole()), -1)
    for i in range(n):
        broken = broken.when(~row.rlike(schema.prefix(i + 1)), i)
    out = df.withColumn("reject_field", broken.otherwise(n))
    at = F.col("reject_field")
    reason = (
        F.when(at < 0, None)
        .when(row.isNull(), "columns")
        .when(~row.rlike(schema.structure()), "quoting")
        .when((at == n) | ~row.rlike(schema.structure(n)), "columns")
        .otherwise("value")
    )
    names = F.array(*[F.lit(f.name) for f in schema.fields])
    return out.withColumn("reject_reason", reason).withColumn("reject_field", F.when(at >= 0, F.get(names, at))).select(*[F.col(f"`{c}`") for c in df.columns if c not in ("reject_reason", "reject_field")], "reject_reason", "reject_field")


def rejected_rows(df: DataFrame, text: str, schema: RowSchema) -> DataFrame:
    """The rows that fail, with ``reject_reason`` and ``reject_field``; see :func:`classify_rows`."""
    return classify_rows(df, text, schema).where("reject_reason is not null")


def load_rows(df: DataFrame, text: str, schema: RowSchema, keep: Sequence[str] = ()) -> DataFrame:
    """The valid rows, typed by the schema, beside the columns ``keep``; see :func:`classify_rows`.

    An empty field is null. Text keeps its line ends, and doubled quotes are single again.
    """
    valid = classify_rows(df, text, schema).where("reject_reason is null")
    # every cell has its comma in front, so an empty first cell is a match like others
    cells = F.regexp_extract_all(F.concat(F.lit(","), F.col(f"`{text}`")), F.lit(rf",({_ANY})"), F.lit(1))
    valid = valid.select(*[F.col(f"`{c}`") for c in keep], cells.alias("__cells"))
    out = [F.col(f"`{c}`") for c in keep]
    for i, f in enumerate(schema.fields):
        raw = F.get("__cells", F.lit(i))
        value = F.when(raw.startswith('"'), F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))).otherwise(raw)
        value = F.when(value != "", value)
        if f.kind.startswith("array:"):
            value = F.split(value, f"\\Q{f.kind[6:]}\\E")
        elif f.kind != "string":
            value = value.cast(f.kind)
        out.append(value.alias(f.name))
    return valid.select(*out)


#: The raw form of the table of rows that were not kept (11 fields).
IGNORED_ROW = RowSchema(
    (
        RowField("chrom", empty=False),
        RowField("filter", "array:;"),
        RowField("vartype", pattern="BND|TRA"),
        RowField("vcf_ignored", empty=False),
        RowField("vcf_pos", "long", LONG, empty=False),
        RowField("vcf_id"),
        RowField("vcf_ref", empty=False),
        RowField("vcf_alt", empty=False),
        RowField("vcf_qual", "float", DECIMAL),
        RowField("vcf_rec", "long", LONG, empty=False),
        RowField("vcf_allele", "int", INT, empty=False),
    )
)
