"""Which columns hold chromosome, start and end, and how names are kept apart."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CoordCol:
    """Names of the coordinate columns."""

    chrom: str = "chrom"
    pos: str = "pos"
    end: str = "end"

    def __post_init__(self) -> None:
        names = (self.chrom, self.pos, self.end)
        if any(not isinstance(n, str) or not n.strip() for n in names):
            raise ValueError(f"column names must be non-blank text: {names!r}")
        if len(set(names)) < 3:
            raise ValueError(f"column names must differ: {names!r}")

    def __iter__(self) -> Iterator[str]:
        return iter((self.chrom, self.pos, self.end))

    def __contains__(self, name: object) -> bool:
        return name in (self.chrom, self.pos, self.end)

    def suffixed(self, suffix: str) -> CoordCol:
        return CoordCol(*(f"{n}{suffix}" for n in self))

    def columns(self) -> tuple[Column, Column, Column]:
        """The same as Spark columns."""
        return tuple(F.col(f"`{n}`") for n in self)  # type: ignore[return-value]


REFERENCE = CoordCol()
QUERY = CoordCol("qry_id", "qry_pos", "qry_end")


def get_coord_cols(names: CoordCol | Iterable[str] | str | None = None) -> CoordCol:
    """``None`` or ``'ref'``, ``'qry'``, three names, or a :class:`CoordCol`."""
    if names is None:
        return REFERENCE
    if isinstance(names, CoordCol):
        return names
    if isinstance(names, str):
        try:
            return {"ref": REFERENCE, "qry": QUERY}[names.strip().lower()]
        except KeyError:
            raise ValueError(f"unknown coordinates {names!r}; known: 'ref', 'qry'") from None
    listed = list(names)
    if len(listed) != 3:
        raise ValueError(f"three column names are needed, not {len(listed)}")
    return CoordCol(*listed)


def make_unique(name: str, taken: Iterable[str]) -> str:
    """``name``, or ``name_1``, ``name_2``, ... - the first that is not taken."""
    used, n, out = set(taken), 0, name
    while out in used:
        n += 1
        out = f"{name}_{n}"
    return out


def rename_collisions(names: Iterable[str], sep: str = ".") -> list[str]:
    """Later repetitions of a name get ``.1``, ``.2``, ... such that all names differ."""
    names = list(names)
    out: list[str] = []
    for name in names:
        n, new = 0, name
        while new in out or (n and new in names):
            n += 1
            new = f"{name}{sep}{n}"
        out.append(new)
    return out


def standardize(name: str) -> str:
    """Lower case, with every run of other characters than letters and digits as one ``_``."""
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")
