"""The header of a VCF file: read, checked softly, changed, and written as text.

A value that the format does not allow is replaced by a fallback (Number ``.``, Type ``String``) and
the reason is kept with the line, so broken files can still be read.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field

from pyspark.sql import types as T

VCF_VERSION = "4.2"
SOURCE = "strandlake"

# Fixed values of the format.
NUMBER_CODES = ("A", "R", "G", ".")
INFO_TYPES = ("Integer", "Float", "Flag", "Character", "String")
FORMAT_TYPES = ("Integer", "Float", "Character", "String")
SPARK_TYPES: dict[str, T.DataType] = {"Integer": T.LongType(), "Float": T.DoubleType(), "Flag": T.BooleanType(), "Character": T.StringType(), "String": T.StringType()}
_ORDER = {
    "contig": ("ID", "length", "URL", "md5", "assembly"),
    "INFO": ("ID", "Number", "Type", "Description", "Source", "Version"),
    "FORMAT": ("ID", "Number", "Type", "Description"),
    "FILTER": ("ID", "Description"),
    "ALT": ("ID", "Description"),
}
_QUOTED = {"Description", "Source", "Version"}
_COLUMNS = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"


def parse_number(value: int | str) -> int | str:
    """A whole number not below 0, or one of ``A R G .``; else a ValueError."""
    if isinstance(value, int) and not isinstance(value, bool):
        if value >= 0:
            return value
    else:
        text = str(value).strip()
        if text in NUMBER_CODES:
            return text
        if re.fullmatch(r"[0-9]+", text):
            return int(text)
    raise ValueError(f"Number {value!r} is neither a whole number nor one of {', '.join(NUMBER_CODES)}")


def column_type(number: int | str, kind: str) -> T.DataType:
    """Flag: boolean; Number 1 or A: one value (Number 0 too); else a list."""
    base = SPARK_TYPES[kind]
    if kind == "Flag" or number in (0, 1, "A"):
        return base
    return T.ArrayType(base)


def spark_to_vcf_type(dtype: T.DataType) -> str:
    """Integer, Float, Flag or String; other types are a TypeError."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "Integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "Float"
    if isinstance(dtype, T.BooleanType):
        return "Flag"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "String"
    raise TypeError(f"no VCF type for {dtype.simpleString()}")


@dataclass(frozen=True)
class HeaderLine:
    """A structured line: its kind, its fields by name, and what was wrong with it."""

    kind: str
    fields: dict[str, object]
    errors: tuple[str, ...] = ()

    @property
    def id(self) -> str:
        return str(self.fields["ID"])

    @property
    def number(self) -> int | str:
        return self.fields["Number"]  # type: ignore[return-value]

    @property
    def type(self) -> str:
        return str(self.fields["Type"])

    @property
    def description(self) -> str:
        return str(self.fields.get("Description", ""))

    @property
    def is_valid(self) -> bool:
        return not self.errors

    def spark_type(self) -> T.DataType:
        return column_type(self.number, self.type)

    def __str__(self) -> str:
        names = [n for n in _ORDER[self.kind] if self.fields.get(n) is not None]
        names += [n for n in self.fields if n not in names and self.fields[n] is not None]
        parts = []
        for n in names:
            text = str(self.fields[n])
            if n in _QUOTED:
                text = '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'
            parts.append(f"{n}={text}")
        return f"##{self.kind}=<{','.join(parts)}>"


def _checked(kind: str, fields: dict[str, object]) -> HeaderLine:
    fields, errors = dict(fields), []
    if not str(fields.get("ID") or "").strip():
        raise ValueError(f"a {kind} line needs an ID")
    if kind in ("INFO", "FORMAT"):
        try:
            fields["Number"] = parse_number(fields.get("Number", "."))  # type: ignore[arg-type]
        except ValueError as e:
            errors.append(f"{fields['ID']}: {e}")
            fields["Number"] = "."
        allowed = INFO_TYPES if kind == "INFO" else FORMAT_TYPES
        if fields.get("Type") not in allowed:
            errors.append(f"{fields['ID']}: Type {fields.get('Type')!r} is none of {', '.join(allowed)}")
            fields["Type"] = "String"
        elif fields["Type"] == "Flag" and fields["Number"] != 0:
            errors.append(f"{fields['ID']}: a Flag has Number 0, not {fields['Number']}")
    if kind == "contig" and fields.get("length") is not None:
        try:
            fields["length"] = int(str(fields["length"]))
            if fields["length"] < 0:
                raise ValueError
        except ValueError:
            errors.append(f"{fields['ID']}: length {fields['length']!r} is no length")
            fields["length"] = None
    if kind != "contig" and fields.get("Description") is None:
        errors.append(f"{fields['ID']}: no Description")
        fields["Description"] = ""
    return HeaderLine(kind, fields, tuple(errors))


@dataclass
class VcfHeader:
    """Lines by kind and ID, in the order they were added; samples; and free ``##key=value`` lines."""

    vcf_version: str = VCF_VERSION
    file_date: str | None = None
    source: str | None = SOURCE
    reference: str | None = None
    warn_invalid: bool = True
    lines: dict[str, dict[str, HeaderLine]] = field(default_factory=lambda: {k: {} for k in _ORDER})
    samples: list[str] = field(default_factory=list)
    meta: list[tuple[str, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.vcf_version = self.vcf_version.strip().removeprefix("VCFv")
        if not self.vcf_version:
            raise ValueError("the version is blank")
        if self.file_date is not None and not re.fullmatch(r"\S+", self.file_date):
            raise ValueError(f"no date: {self.file_date!r}")

    def add(self, kind: str, **fields: object) -> HeaderLine:
        """Adds a line; an ID that is there already is a ValueError."""
        line = _checked(kind, fields)
        if line.id in self.lines[kind]:
            raise ValueError(f"{kind} {line.id} is there already")
        self.lines[kind][line.id] = line
        if self.warn_invalid:
            for e in line.errors:
                warnings.warn(f"{kind} line kept with fallback values: {e}", UserWarning, stacklevel=3)
        return line

    def remove(self, kind: str, ident: str) -> None:
        del self.lines[kind][ident]

    def add_contig(self, ident: str, length: int | None = None, url: str | None = None, md5: str | None = None, assembly: str | None = None, **extra: object) -> HeaderLine:
        return self.add("contig", ID=ident, length=length, URL=url, md5=md5, assembly=assembly, **extra)

    def add_info(self, ident: str, number: int | str, type: str, description: str, source: str | None = None, version: str | None = None, **extra: object) -> HeaderLine:
        return self.add("INFO", ID=ident, Number=number, Type=type, Description=description, Source=source, Version=version, **extra)

    def add_format(self, ident: str, number: int | str, type: str, description: str, **extra: object) -> HeaderLine:
        return self.add("FORMAT", ID=ident, Number=number, Type=type, Description=description, **extra)

    def add_filter(self, ident: str, description: str, **extra: object) -> HeaderLine:
        return self.add("FILTER", ID=ident, Description=description, **extra)

    def add_alt(self, ident: str, description: str, **extra: object) -> HeaderLine:
        return self.add("ALT", ID=ident, Description=description, **extra)

    def add_sample(self, name: str) -> None:
        if not name.strip() or "\t" in name or name in self.samples:
            raise ValueError(f"blank, split or repeated sample name {name!r}")
        self.samples.append(name)

    def remove_sample(self, name: str) -> None:
        self.samples.remove(name)

    def add_meta(self, key: str, value: str) -> None:
        if not re.fullmatch(r"[^\s=]+", key):
            raise ValueError(f"no key: {key!r}")
        self.meta.append((key, value))

    def remove_meta(self, key: str) -> None:
        self.meta = [m for m in self.meta if m[0] != key]

    @property
    def contigs(self) -> list[HeaderLine]:
        return list(self.lines["contig"].values())

    @property
    def info(self) -> list[HeaderLine]:
        return list(self.lines["INFO"].values())

    @property
    def formats(self) -> list[HeaderLine]:
        return list(self.lines["FORMAT"].values())

    @property
    def filters(self) -> list[HeaderLine]:
        return list(self.lines["FILTER"].values())

    @property
    def alts(self) -> list[HeaderLine]:
        return list(self.lines["ALT"].values())

    @property
    def validation_errors(self) -> list[str]:
        return [f"{k} {e}" for k, lines in self.lines.items() for x in lines.values() for e in x.errors]

    @property
    def is_valid(self) -> bool:
        return not self.validation_errors

    def __str__(self) -> str:
        out = [f"##fileformat=VCFv{self.vcf_version}"]
        out += [f"##{k}={v}" for k, v in (("fileDate", self.file_date), ("source", self.source), ("reference", self.reference)) if v]
        out += map(str, self.contigs)
        out += [f"##{k}={v}" for k, v in self.meta]
        for kind in (self.info, self.filters, self.formats, self.alts):
            out += map(str, kind)
        out.append(_COLUMNS + ("\tFORMAT\t" + "\t".join(self.samples) if self.samples else ""))
        return "\n".join(out) + "\n"


_FIELD = re.compile(r'\s*([^=,\s]+)\s*=\s*(?:"((?:[^"\\]|\\.)*)"|([^,]*))\s*(?:,|$)')


def _fields(text: str) -> dict[str, object]:
    out: dict[str, object] = {}
    for m in _FIELD.finditer(text):
        out.setdefault(m[1], re.sub(r"\\(.)", r"\1", m[2]) if m[2] is not None else m[3].strip())
    return out


def parse_header(lines: list[str], warn_invalid: bool = False) -> VcfHeader:
    """From the lines that begin with ``#``.  Repeated IDs: the first counts.  A missing date stays unset."""
    header = VcfHeader(source=None, warn_invalid=warn_invalid)
    for raw in lines:
        line = raw.rstrip("\r\n")
        if line.startswith("#CHROM"):
            for name in line.split("\t")[9:]:
                header.add_sample(name)
            continue
        key, eq, value = line[2:].partition("=")
        if not line.startswith("##") or not eq:
            continue
        if key == "fileformat":
            header.vcf_version = value.strip().removeprefix("VCFv")
        elif key == "fileDate":
            header.file_date = value.strip() or None
        elif key == "source" and header.source is None:
            header.source = value
        elif key == "reference":
            header.reference = value
        elif key in _ORDER and value.startswith("<") and value.endswith(">"):
            fields = _fields(value[1:-1])
            if fields.get("ID") and fields["ID"] not in header.lines[key]:
                header.add(key, **fields)
        else:
            header.meta.append((key, value))
    return header
