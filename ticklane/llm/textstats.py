"""Counts over one text, shared by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np

SYMBOLS = b"#*$%&|<>"
_KEEP_SYMBOLS = bytes(x for x in range(256) if x not in SYMBOLS)
_CONTINUED = bytes(range(0x80, 0xC0))
SPACES = b" \t\n\v\f\r"


def code_points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.translate(None, _CONTINUED))


def numbered(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words by first occurrence, and the number of each word among them."""
    distinct = list(dict.fromkeys(words))
    return distinct, np.fromiter(map(dict(zip(distinct, range(len(distinct)))).__getitem__, words), np.int64, len(words))


def repeated_words(ids: np.ndarray) -> int:
    """Words that stand in a 3-word window found twice or more in the text."""
    if len(ids) < 4:
        return 0
    n = int(ids.max()) + 1
    if n < 1 << 21:
        codes = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        codes = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)[1] * n + ids[2:]
    order = np.argsort(codes, kind="stable")
    same = np.diff(codes[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(len(codes), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(codes)] |= twice
    return int(covered.sum())


def duplicate_lines(data: bytes) -> tuple[int, int]:
    """(lines with a word that equal an earlier line, lines with a word)."""
    if b"\n" not in data:
        return 0, int(bool(data.strip(SPACES)))
    lines = [x for x in data.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines)), len(lines)


def symbol_count(data: bytes) -> int:
    return len(data.translate(None, _KEEP_SYMBOLS))
