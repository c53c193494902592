"""The text form of merge strategies, such as ``nr::ro(0.5):szro(0.5,200):match(0.8)``.

Grammar::

    strategy := KEYWORD '::' spec (':' spec)*
    spec     := KEYWORD [ '(' [args] ')' ]
    args     := arg (',' arg)*          (arguments may also be parted by ';')
    arg      := [KEYWORD '='] value | nothing
    value    := number[k|m|g] | 'unlimited' | 'true' | 'false' | match[(args)] | '[' value, ... ']'

A strategy compiles to the stages of an overlap join, which is an extension of our own: ``ro`` to
``ro_min``, ``szro`` to ``size_ro_min``, ``dist`` to ``offset_max``, ``szdist`` to
``offset_prop_max``, ``exact`` to equal positions, ``ref``/``alt`` to equal alleles, ``match`` to
``match_prop_min`` and the score model.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from typing import Any

from strandlake.functions.similarity import MatchScoreModel
from strandlake.operators.overlap import OverlapStage, PairwiseOverlap

UNLIMITED = math.inf
_TOKEN = re.compile(r"\s*(?:(?P<num>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?P<mult>[kKmMgG])?(?![A-Za-z0-9_.])|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<mark>::|[:;,=()\[\]]))")
_MULTIPLIER = {"k": 10**3, "m": 10**6, "g": 10**9}


@dataclass(frozen=True)
class Spec:
    """A stage as written: its keyword and its (name or None, value) arguments; None is left out."""

    name: str
    args: tuple[tuple[str | None, Any], ...] = ()


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, [], 0
        place, end = 0, len(text.rstrip())
        while place < end:
            m = _TOKEN.match(text, place)
            if not m:
                raise ValueError(f"illegal character at {place} of {text!r}: {text[place : place + 20]!r}")
            self.tokens.append(m)
            place = m.end()

    def peek(self, mark: str | None = None) -> bool:
        if self.at >= len(self.tokens):
            return False
        return mark is None or self.tokens[self.at]["mark"] == mark

    def take(self, mark: str) -> None:
        if not self.peek(mark):
            self.fail(f"{mark!r} is expected")
        self.at += 1

    def fail(self, why: str) -> None:
        where = self.tokens[self.at].start() if self.at < len(self.tokens) else len(self.text)
        raise ValueError(f"{why} at {where} of {self.text!r}")

    def word(self) -> str:
        if not self.peek() or not self.tokens[self.at]["word"]:
            self.fail("a word is expected")
        self.at += 1
        return self.tokens[self.at - 1]["word"]

    def spec(self) -> Spec:
        name, args = self.word().lower(), ()
        if self.peek("("):
            self.take("(")
            args = self.arguments(")")
            self.take(")")
        return Spec(name, args)

    def arguments(self, close: str) -> tuple[tuple[str | None, Any], ...]:
        out: list[tuple[str | None, Any]] = []
        while not self.peek(close):
            if self.peek(",") or self.peek(";"):
                out.append((None, None))
            else:
                out.append(self.argument())
            if self.peek(close):
                break
            if self.peek(";"):
                self.take(";")
            else:
                self.take(",")
        return tuple(out)

    def argument(self) -> tuple[str | None, Any]:
        if not self.peek():
            self.fail("a value or ')' is expected")
        follows = self.tokens[self.at + 1]["mark"] if self.at + 1 < len(self.tokens) else None
        if self.tokens[self.at]["word"] and follows == "=":
            name = self.word().lower()
            self.take("=")
            return name, self.value()
        return None, self.value()

    def value(self) -> Any:
        if not self.peek():
            self.fail("a value is expected")
        token = self.tokens[self.at]
        if token["num"]:
            self.at += 1
            whole = re.fullmatch(r"[+-]?\d+", token["num"])
            number = int(token["num"]) if whole else float(token["num"])
            if token["mult"]:
                number *= _MULTIPLIER[token["mult"].lower()]
                number = int(number) if number == int(number) else number
            return number
        if token["mark"] == "[":
            self.take("[")
            items = []
            while not self.peek("]"):
                items.append(self.value())
                if not self.peek("]"):
                    self.take(",")
            self.take("]")
            return items
        word = (token["word"] or "").lower()
        if word in ("true", "false"):
            self.at += 1
            return word == "true"
        if word in ("unlimited", "unlim"):
            self.at += 1
            return UNLIMITED
        if word == "match":
            return self.spec()
        self.fail("a value is expected")


@dataclass(frozen=True)
class ParamSpec:
    """What an argument may be: ``kind`` is int, num, bool or list; ``_u`` allows ``unlimited`` (no condition)."""

    name: str
    kind: str
    default: Any = None
    low: float | None = None
    low_open: bool = False
    high: float | None = None

    def check(self, value: Any, where: str) -> Any:
        kind, unlimited = self.kind.removesuffix("_u"), self.kind.endswith("_u")
        if value == UNLIMITED and not isinstance(value, bool):
            if not unlimited:
                raise ValueError(f"{where}: {self.name} cannot be unlimited")
            return None
        good = {"bool": lambda v: isinstance(v, bool), "int": lambda v: isinstance(v, int) and not isinstance(v, bool), "num": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "list": lambda v: isinstance(v, list)}[kind]
        if not good(value):
            raise ValueError(f"{where}: {self.name} = {value!r} is no {kind}")
        if kind in ("int", "num"):
            if self.low is not None and (value < self.low or (self.low_open and value == self.low)):
                raise ValueError(f"{where}: {self.name} = {value!r} is too small")
            if self.high is not None and value > self.high:
                raise ValueError(f"{where}: {self.name} = {value!r} is too large")
        return value


def _p(name: str, kind: str, default: Any = None, low: float | None = None, low_open: bool = False, high: float | None = None) -> ParamSpec:
    return ParamSpec(name, kind, default, low, low_open, high)


# The stages, their arguments in order, and the defaults.
PARAMS: dict[str, tuple[ParamSpec, ...]] = {
    "ro": (_p("ro", "num", 0.5, 0, True, 1), _p("dist", "int_u", None, 0), _p("szdist", "num_u", None, 0), _p("szro", "num", None, 0, True, 1)),
    "szro": (_p("szro", "num", 0.5, 0, True, 1), _p("dist", "int_u", None, 0), _p("szdist", "num_u", None, 0)),
    "distance": (_p("dist", "int_u", 500, 0), _p("szdist", "num_u", None, 0), _p("szro", "num_u", None, 0, True, 1), _p("alt", "bool", False), _p("ref", "bool", False)),
    "exact": (_p("alt", "bool", False), _p("ref", "bool", False)),
    "match": (_p("score", "num", 0.8, 0, True, 1), _p("match", "num", 2.0, 0, True), _p("mismatch", "num", 4.0, 0), _p("gap", "list", [4.0, 2.0, 24.0, 1.0]), _p("limit", "int_u", 5000, 0), _p("ksize", "int", 9, 1)),
}


def _values(spec: Spec) -> tuple[dict[str, Any], Spec | None]:
    if spec.name not in PARAMS:
        raise ValueError(f"unknown stage {spec.name!r}; known: {', '.join(sorted(PARAMS))}")
    params, out, match, place, named = PARAMS[spec.name], {}, None, 0, False
    for name, value in spec.args:
        if isinstance(value, Spec):
            if match is not None or spec.name == "match":
                raise ValueError(f"{spec.name}: one match at most, and none within a match")
            match = value
            continue
        if name is None:
            if named and value is not None:
                raise ValueError(f"{spec.name}: a positional value after a named one")
            if place >= len(params):
                raise ValueError(f"{spec.name}: too many values")
            p, place = params[place], place + 1
        else:
            named = True
            p = next((q for q in params if q.name == name), None)
            if p is None:
                raise ValueError(f"{spec.name}: unknown argument {name!r}")
        if p.name in out:
            raise ValueError(f"{spec.name}: {p.name} is given twice")
        if value is not None:
            out[p.name] = p.check(value, spec.name)
    return {p.name: out.get(p.name, p.default) for p in params}, match


def _score_model(values: dict[str, Any]) -> MatchScoreModel:
    gap = values["gap"]
    if not gap or len(gap) % 2:
        raise ValueError("match: gap needs pairs of values")
    pairs = tuple((float(a), float(b)) for a, b in zip(gap[::2], gap[1::2], strict=True))
    return MatchScoreModel(float(values["match"]), float(values["mismatch"]), pairs, values["limit"], values["ksize"])


@dataclass(frozen=True)
class MergeStrategy:
    """A parsed strategy: its name, its stages as written, and the match that holds for all stages."""

    name: str
    specs: tuple[Spec, ...]
    match: Spec | None

    @classmethod
    def parse(cls, text: str) -> MergeStrategy:
        reader = _Reader(text)
        name = reader.word().lower()
        reader.take("::")
        specs = [reader.spec()]
        while reader.peek():
            reader.take(":")
            specs.append(reader.spec())
        if name != "nr":
            raise ValueError(f"unknown strategy {name!r}; known: nr")
        global_match = [s for s in specs if s.name == "match"]
        if len(global_match) > 1:
            raise ValueError("a strategy has one match at most")
        own = tuple(s for s in specs if s.name != "match")
        if not own:
            raise ValueError("a strategy needs a stage besides the match")
        out = cls(name, own, global_match[0] if global_match else None)
        out.compile()  # all values are checked at once
        return out

    def compile(self) -> tuple[tuple[OverlapStage, ...], MatchScoreModel]:
        """The stages of the overlap join, and the score model of their matches."""
        stages, models = [], set()
        for spec in self.specs:
            v, match = _values(spec)
            match = match or self.match
            args: dict[str, Any] = {"ro_min": v.get("ro"), "size_ro_min": v.get("szro"), "offset_max": v.get("dist"), "offset_prop_max": v.get("szdist"), "match_ref": bool(v.get("ref")), "match_alt": bool(v.get("alt"))}
            if spec.name == "ro":
                args["match_ref"] = args["match_alt"] = False
            if spec.name == "exact":
                args = {"offset_max": 0, "match_ref": v["ref"], "match_alt": v["alt"]}
            if spec.name == "distance":
                args["ro_min"] = None
                if v["dist"] is None and v["szdist"] is None:
                    raise ValueError("distance: dist or szdist must be limited")
            if match is not None:
                values, _ = _values(match)
                args["match_prop_min"] = values["score"]
                models.add(_score_model(values))
            stages.append(OverlapStage(**args))
        if len(models) > 1:
            raise ValueError("the matches of a strategy must agree in all but the score")
        return tuple(stages), models.pop() if models else MatchScoreModel()

    def overlap(self, **args: Any) -> PairwiseOverlap:
        stages, model = self.compile()
        return PairwiseOverlap(stages, match_score_model=model, **args)
