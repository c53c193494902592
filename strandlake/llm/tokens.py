"""Token sizes by a public byte-level tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pattern that cuts text into words before byte pairs are merged (fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokenizer:
    """Ids and byte lengths of tokens; every token has at least one byte, so tokens <= bytes."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.widths[rank] = len(token)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self._encoding.encode_ordinary(text), np.int64)

    def count(self, text: str) -> int:
        return len(self._encoding.encode_ordinary(text))


@lru_cache(maxsize=2)
def tokenizer(path: str = VOCABULARY) -> ByteTokenizer:
    """One tokenizer per Python worker."""
    return ByteTokenizer(path)


def text_slices(texts: pa.Array, max_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """(first row, end row) of runs of rows with about ``max_bytes`` of text each; one row at least.

    Spark bounds an Arrow batch by bytes; what is made of its texts in Python takes several times as
    much, so work that gathers texts goes through a batch in runs.
    """
    size = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
    first = 0
    while first < len(texts):
        before = size[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(size, before + max_bytes, "right")))
        yield first, end
        first = end
