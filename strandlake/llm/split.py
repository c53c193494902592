"""Cutting oversized texts into overlapping pieces at natural boundaries.

Method: content-defined chunking.  A rolling hash over tokens marks landmarks, each landmark snaps
to the nearest natural boundary, and a piece ends at the first snapped landmark past its least
size.  Where to cut thus depends on nearby content only, so an edit alters only neighbouring pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.tokens import VOCABULARY, ByteTokenizer, tokenizer

#: Boundaries of a commit, strongest last; a piece begins at the end of the match.
_BOUNDARIES = (rb"\n", rb"\n[ \t]*\n", rb"\n(?=@@ )", rb"\n(?=diff --git |Index: |commit [0-9a-f]{7,}|From [0-9a-f]{7,}|---\n)")
_WINDOW = 16
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class SplitRule:
    """Sizes in tokens: ``limit`` of a piece, ``overlap`` with the piece before, ``least`` new tokens
    of a piece that ends at a landmark, ``spacing`` (a power of two) of landmarks on average, and
    ``reach`` within which a landmark looks for a natural boundary."""

    limit: int = 4096
    overlap: int = 128
    least: int = 2048
    spacing: int = 256
    reach: int = 96

    def __post_init__(self) -> None:
        if not (0 <= self.overlap and self.overlap + 8 < self.limit and 0 < self.least <= self.limit - self.overlap and self.spacing & (self.spacing - 1) == 0):
            raise ValueError(f"sizes do not fit together: {self}")


def _landmarks(ids: np.ndarray, spacing: int) -> np.ndarray:
    """Token positions at which the hash of the ``_WINDOW`` tokens before them has its low bits zero."""
    if len(ids) <= _WINDOW:
        return np.zeros(0, np.int64)
    x, h = ids.astype(np.uint64) + np.uint64(1), np.zeros(len(ids) - _WINDOW + 1, np.uint64)
    for j in range(_WINDOW):
        h = h * _MULTIPLIER + x[j : j + len(h)]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero((h >> np.uint64(32)) & np.uint64(spacing - 1) == 0) + _WINDOW


def _strength(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """For each token boundary: -1 inside a character, 0 plain, 1..4 the strongest natural boundary."""
    raw = np.frombuffer(data + b" ", np.uint8)
    strength = np.where((raw[offsets] & 0xC0) == 0x80, -1, 0)
    for level, pattern in enumerate(_BOUNDARIES, 1):
        ends = np.array([m.end() for m in re.finditer(pattern, data)], np.int64)
        at = np.searchsorted(offsets, ends)
        strength[at[offsets[at] == ends]] = level
    return strength


def _snapped(marks: np.ndarray, strength: np.ndarray, reach: int) -> np.ndarray:
    """Each landmark moved to the nearest boundary of a paragraph or more, else of a line, else of a character."""
    places = [np.flatnonzero(strength >= s) for s in (2, 1, 0)]
    out = []
    for m in marks:
        for p in places:
            k = np.searchsorted(p, m)
            near = [int(q) for q in p[max(0, k - 1) : k + 1] if abs(int(q) - m) <= reach]
            if near:
                out.append(min(near, key=lambda q: (abs(q - m), q)))
                break
    return np.unique(np.array(out, np.int64))


def _end(done: int, most: int, candidates: np.ndarray, strength: np.ndarray, rule: SplitRule) -> int:
    """Where a piece ends: at the first landmark on a natural boundary past its least size, else at the
    strongest and latest natural boundary there is past it, else at the first landmark, else at the
    last character."""
    own = candidates[np.searchsorted(candidates, done + rule.least) : np.searchsorted(candidates, most, "right")]
    natural = own[strength[own] > 0]
    if len(natural):
        return int(natural[0])
    low = max(done + 1, min(done + rule.least, most))
    tail = strength[low : most + 1]
    best = int(tail.max())
    if best <= 0 and len(own):
        return int(own[0])
    # one character may have more tokens than a piece has: it is cut at the limit then
    return low + int(np.flatnonzero(tail == best)[-1]) if best >= 0 else most


def cut_points(ids: np.ndarray, data: bytes, tok: ByteTokenizer, rule: SplitRule) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(first token, end token) of the pieces, overlap included, and the byte offset of every token.

    A piece has at most ``rule.limit`` tokens of the whole text and, tokenized on its own, as well.
    """
    n, offsets = len(ids), np.concatenate([[0], np.cumsum(tok.widths[ids])])
    strength = _strength(data, offsets)
    chars, candidates = np.flatnonzero(strength >= 0), _snapped(_landmarks(ids, rule.spacing), strength, rule.reach)
    pieces, done = [], 0
    own_size = lambda a, b: tok.count(data[offsets[a] : offsets[b]].decode("utf-8", "replace"))
    while True:
        # the overlap has exactly the wanted size unless that would begin inside a character
        first = int(chars[np.searchsorted(chars, max(0, done - rule.overlap), "right") - 1]) if done else 0
        most = min(n, first + rule.limit)
        end = n if most == n else _end(done, most, candidates, strength, rule)
        # cut off from what stood around it, a piece may have more tokens at its ends: it ends earlier then
        while (over := own_size(first, end) - rule.limit) > 0 and end - over > done:
            most = end - over
            end = _end(done, most, candidates, strength, rule)
        pieces.append((first, end))
        if end == n:
            return pieces, offsets
        done = end


def split_text(text: str, rule: SplitRule, tok: ByteTokenizer) -> list[tuple[int, int, int, int, str]]:
    """(first token, end token, first byte, end byte, text) per piece; one piece if the text fits."""
    data = text.encode("utf-8", "replace")
    ids = tok.ids(data.decode())
    if len(ids) <= rule.limit:
        return [(0, len(ids), 0, len(data), text)]
    pieces, offsets = cut_points(ids, data, tok, rule)
    return [(a, b, int(offsets[a]), int(offsets[b]), data[offsets[a] : offsets[b]].decode("utf-8", "replace")) for a, b in pieces]


_OUT = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("n_pieces", pa.int32()), ("token_from", pa.int64()), ("token_to", pa.int64()), ("byte_from", pa.int64()), ("byte_to", pa.int64()), ("piece_text", pa.string())])


def split_oversized(df: DataFrame, ident: str, text: str, rule: SplitRule | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The pieces of every text above ``rule.limit`` tokens, one row each.

    Columns: ``id, piece`` (from 0), ``n_pieces, token_from, token_to, byte_from, byte_to,
    piece_text``.  Tokens and bytes are those of the whole text; neither ``token_to - token_from`` nor
    the tokens of ``piece_text`` on its own exceed the limit, a piece after the first begins ``rule.overlap`` tokens before the end of the
    one before it (up to 3 more where that would fall inside a character), and the pieces without
    their overlaps are the text.

    Defined cases: null and empty texts, and all texts that fit, have no pieces here (texts with no
    more bytes than the limit are not even tokenized: a token has a byte at least); a text without
    any natural boundary is cut between characters; repeated rows are cut each on its own; a null id
    is kept; an empty table gives no rows; further columns are not read.
    """
    rule = rule or SplitRule()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        for batch in batches:
            for ident_, text_ in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pieces = split_text(text_.as_py(), rule, tok)
                if len(pieces) > 1:
                    rows = [(ident_, i, len(pieces), *p) for i, p in enumerate(pieces)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

    long_texts = df.where(F.octet_length(F.col(f"`{text}`")) > rule.limit).select(F.col(f"`{ident}`").cast("long"), F.col(f"`{text}`"))
    return long_texts.mapInArrow(run, "id long, piece int, n_pieces int, token_from long, token_to long, byte_from long, byte_to long, piece_text string")
