"""Word runs: the one tokenisation that SQL expressions and Arrow functions share.

A word is a maximal run of letters and digits, lower-cased.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.memo import Memo

WORD = re.compile(r"[^\W_]+")
#: The same class for the JVM's regex engine.
WORD_SQL = r"[\p{L}\p{N}]+"
#: Blanks that separate plain tokens: spaces, tabs and line breaks.
TOKEN_SQL = r"[^ \t\r\n]+"

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[str]:
    """Words of a text; an absent text has none."""
    if not text:
        return []
    if text.isascii():
        return text.encode("ascii").translate(_FOLD).decode("ascii").split()
    return WORD.findall(text.lower())


def word_array(text: Column) -> Column:
    """Words as a SQL array; null stays null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_SQL), F.lit(0))


def token_count(text: Column) -> Column:
    """Runs of characters between spaces, tabs and line breaks; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_SQL)), F.lit(0))


def hash64(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


class WordHash(Memo):
    """64-bit hash of each word, the same on every machine."""

    def __init__(self, f=hash64, bound: int = 1_000_000) -> None:
        super().__init__(f, bound)

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` consecutive words, in order; none if there are fewer words."""
    n = len(h) - size + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        out = out * _STEP[0] + mix64(h[i : i + n] + _STEP[i % 5])
    return mix64(out)
