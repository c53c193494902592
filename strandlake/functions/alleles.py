"""Classification of VCF alleles into variant types, coordinates and sequences, in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The table of each type, and the types that rows left out keep.
TABLE_OF = {"INS": "insdel", "DEL": "insdel", "SNV": "snv", "SUB": "sub", "DUP": "dup", "INV": "inv", "CPX": "cpx"}
KEPT_IGNORED = ("BND", "TRA")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` needs it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two texts: the first place at which they differ."""

    def walk(x: Column) -> Column:
        p, q, n = x["p"], x["q"], x["n"]
        same = lambda i: F.substring(p, i, F.lit(1)) == F.substring(q, i, F.lit(1))
        first = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda done, i: F.when((done == i - 1) & same(i), i).otherwise(done))
        # most alleles are equal or differ at once: no walk then
        return F.when(n == 0, F.lit(0)).when(F.left(p, n) == F.left(q, n), n).when(~same(F.lit(1)), F.lit(0)).otherwise(first)

    return bind(F.struct(a.alias("p"), b.alias("q"), F.least(F.length(a), F.length(b)).alias("n")), walk)


def _classified(x: Column) -> Column:
    """From (r, a, pos): what is left of the alleles, and where it begins."""
    r, a, pos, nr, na = x["r"], x["a"], x["pos"], F.length(x["r"]), F.length(x["a"])
    kind = F.when((nr == 0) & (na > 0), "INS").when((nr > 0) & (na == 0), "DEL").when((nr == 1) & (na == 1), "SNV").otherwise("SUB")
    own = kind.isin("SNV", "SUB")
    return F.struct(
        kind.alias("vartype"),
        F.when(kind == "INS", na).when(kind == "DEL", nr).when(kind == "SUB", nr + na).cast("long").alias("varlen"),
        F.when(own, r).alias("ref"),
        F.when(own, a).alias("alt"),
        F.when(kind == "INS", a).when(kind == "DEL", r).alias("seq"),
        pos.alias("pos"),
        (pos + F.when(kind.isin("INS", "SNV"), F.lit(1)).otherwise(nr)).cast("long").alias("end"),
    )


def sequence_allele(pos0: Column, ref: Column, alt: Column) -> Column:
    """Struct (vartype, varlen, ref, alt, seq, pos, end) of an allele that is given as sequence.

    The common suffix, then the common prefix (case aside) are cut off; what is left makes it an
    INS, DEL, SNV or SUB.  Equal alleles are a SUB of length 0.
    """

    def cut_front(x: Column) -> Column:
        n = common_prefix(F.upper(x["r"]), F.upper(x["a"]))
        return bind(n, lambda k: F.struct(F.substring(x["r"], k + 1, F.length(x["r"])).alias("r"), F.substring(x["a"], k + 1, F.length(x["a"])).alias("a"), (x["pos"] + k).cast("long").alias("pos")))

    suffix = common_prefix(F.reverse(F.upper(ref)), F.reverse(F.upper(alt)))
    cut_back = bind(suffix, lambda k: F.struct(F.left(ref, F.length(ref) - k).alias("r"), F.left(alt, F.length(alt) - k).alias("a"), pos0.alias("pos")))
    return bind(bind(cut_back, cut_front), _classified)


def symbolic_allele(pos0: Column, alt: Column, svtype: Column, svlen: Column, info_end: Column, seq: Column) -> Column:
    """Struct like :func:`sequence_allele`, and ``error``, of an allele such as ``<DEL:ME>``.

    The allele's own type wins over ``svtype``.  An insertion needs a length (``svlen``, else that of
    ``seq``); all others take svlen, else end - pos, else that of seq, and end at ``info_end``, else
    pos + length, else pos + 1.  ``conflict`` tells whether the sources of the length disagree.
    """
    own = F.upper(F.substring_index(F.regexp_extract(alt, r"^<(.*)>$", 1), ":", 1))
    kind = F.coalesce(F.when(own != "", own), F.upper(svtype), F.lit("UNK"))
    size = F.abs(svlen.cast("long"))
    span, read = info_end.cast("long") - pos0, F.length(seq).cast("long")
    ins = kind == "INS"
    varlen = F.when(ins, F.coalesce(size, read)).otherwise(F.coalesce(size, span, read))
    end = F.when(ins, pos0 + 1).otherwise(F.coalesce(info_end.cast("long"), pos0 + varlen, pos0 + 1))
    told = F.array_distinct(F.array_compact(F.when(ins, F.array(size, read)).otherwise(F.array(size, span, read))))
    return F.struct(
        kind.alias("vartype"),
        varlen.alias("varlen"),
        F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("string").alias("alt"),
        seq.alias("seq"),
        pos0.cast("long").alias("pos"),
        end.cast("long").alias("end"),
        F.when(ins & varlen.isNull(), F.concat(F.lit("no length for the symbolic insertion "), alt)).alias("error"),
        (F.size(told) > 1).alias("conflict"),
    )
