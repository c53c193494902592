"""A small algebra of scores: weighted columns, summed to elements, of which a strategy picks one."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class ElementPriority(Enum):
    MAX = "max"
    FIRST = "first"


@dataclass(frozen=True)
class WeightColumn:
    """``weight`` times a column; ``scale`` maps [min, max] to [0, 1], inverted if asked.

    ``scale`` is a number (maximum, minimum 0), or (maximum,), (minimum, maximum),
    (minimum, maximum, invert).  ``missing`` stands for a null value or an absent column.
    """

    col: str
    weight: float
    scale: Any = None
    missing: float | None = None

    def __post_init__(self) -> None:
        self.bounds()

    def bounds(self) -> tuple[float, float, bool] | None:
        if self.scale is None:
            return None
        s = self.scale if isinstance(self.scale, (tuple, list)) else (self.scale,)
        if not 1 <= len(s) <= 3:
            raise ValueError(f"a scale has one to three parts: {self.scale!r}")
        low, high = (0.0, s[0]) if len(s) == 1 else (s[0], s[1])
        if low is None or high is None:
            raise ValueError(f"a scale needs both bounds: {self.scale!r}")
        if not low < high or high == 0:
            raise ValueError(f"the bounds of a scale must rise, to another end than 0: {self.scale!r}")
        return float(low), float(high), bool(s[2]) if len(s) == 3 else False

    def expr(self, available: Iterable[str] | None = None) -> Column:
        there = available is None or self.col in set(available)
        value = F.col(f"`{self.col}`").cast("float") if there else F.lit(None).cast("float")
        if self.missing is not None:
            value = F.coalesce(value, F.lit(float(self.missing)).cast("float"))
        scale = self.bounds()
        if scale:
            low, high, invert = scale
            value = (F.when(value.isNull(), None).otherwise(F.greatest(F.least(value, F.lit(high)), F.lit(low))) - F.lit(low)) / F.lit(high - low)
            if invert:
                value = F.lit(1.0) - value
        return value * F.lit(float(self.weight))

    @property
    def max_weight(self) -> float:
        return float(self.weight)


def _column(x: Any) -> WeightColumn:
    if isinstance(x, WeightColumn):
        return x
    return WeightColumn(**x) if isinstance(x, Mapping) else WeightColumn(*x)


@dataclass(frozen=True, init=False)
class WeightElement:
    """The sum of its columns; null if any of them is, then ``missing``."""

    columns: tuple[WeightColumn, ...]
    missing: float | None = None

    def __init__(self, *cols: Any, missing: float | None = None):
        object.__setattr__(self, "columns", tuple(_column(c) for c in cols))
        object.__setattr__(self, "missing", missing)
        if not self.columns:
            raise ValueError("an element needs a column")

    def expr(self, available: Iterable[str] | None = None) -> Column:
        total = self.columns[0].expr(available)
        for c in self.columns[1:]:
            total = total + c.expr(available)
        return total if self.missing is None else F.coalesce(total, F.lit(float(self.missing)))

    @property
    def cols(self) -> frozenset[str]:
        return frozenset(c.col for c in self.columns)

    @property
    def min_weight(self) -> float:
        return 0.0

    @property
    def max_weight(self) -> float:
        return sum(c.max_weight for c in self.columns)


def _element(x: Any) -> WeightElement:
    if isinstance(x, WeightElement):
        return x
    if isinstance(x, Mapping):
        return WeightElement(*x["columns"], missing=x.get("missing"))
    return WeightElement(*x)


@dataclass(frozen=True, init=False)
class WeightStrategy:
    """The largest element (``MAX``) or the first that is not null (``FIRST``), as FLOAT.

    If all elements are null the weight is null; ranking then takes ``missing``.
    """

    elements: tuple[WeightElement, ...]
    missing: float = 0.0
    priority: ElementPriority = field(default=ElementPriority.MAX)

    def __init__(self, *elements: Any, missing: float = 0.0, priority: ElementPriority | str = ElementPriority.MAX):
        object.__setattr__(self, "elements", tuple(_element(e) for e in elements))
        object.__setattr__(self, "missing", float(missing))
        object.__setattr__(self, "priority", ElementPriority(priority.lower()) if isinstance(priority, str) else priority)
        if not self.elements:
            raise ValueError("a strategy needs an element")

    def expr(self, available: Iterable[str] | None = None) -> Column:
        parts = [e.expr(available) for e in self.elements]
        if len(parts) == 1:
            value = parts[0]
        else:
            value = F.greatest(*parts) if self.priority is ElementPriority.MAX else F.coalesce(*parts)
        return value.cast("float")

    @property
    def cols(self) -> frozenset[str]:
        return frozenset().union(*(e.cols for e in self.elements))


# With and without a sequence match.
DEFAULT_WEIGHTS = WeightStrategy(
    [("ro", 0.2), ("size_ro", 0.2), ("offset_prop", 0.1, (0, 2, True)), ("match_prop", 0.5)],
    [("ro", 0.4), ("size_ro", 0.4), ("offset_prop", 0.2, (0, 2, True))],
)
