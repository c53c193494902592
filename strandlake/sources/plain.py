"""Plain or gzip text files on the driver, for headers and other small things."""

from __future__ import annotations

import gzip
import os
from typing import IO


def is_gzip(path: str | os.PathLike) -> bool:
    return os.fspath(path).lower().endswith(".gz")


def open_text(path: str | os.PathLike, mode: str = "r", gz: bool | None = None) -> IO[str]:
    """A text file, through gzip if ``gz`` says so or, by default, if its name ends in ``.gz``."""
    if mode not in ("r", "w"):
        raise ValueError(f"mode {mode!r} is not 'r' or 'w'")
    if is_gzip(path) if gz is None else gz:
        return gzip.open(path, mode + "t", encoding="utf-8")
    return open(path, mode, encoding="utf-8")
