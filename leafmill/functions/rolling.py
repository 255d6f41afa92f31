"""Running Karp-Rabin hashes of every window of a sequence, from one prefix sum modulo 2^64."""

from __future__ import annotations

import numpy as np

from leafmill.functions.memo import Memo
from leafmill.functions.words import mix64

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, dtype=np.uint64)
    n = (1 << bits) - 1
    return tuple(np.concatenate([one, np.cumprod(np.full(n, x, dtype=np.uint64), dtype=np.uint64)]) for x in (_BASE, _INVERSE))


POWERS = Memo(_powers, 64)


def rolling_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive elements (64-bit hashes or codes), in order."""
    n = len(h) - size + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    power, inverse = POWERS[max(8, int(len(h)).bit_length())]
    s = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * power[: len(h)], out=s[1:])
    return mix64((s[size:] - s[:-size]) * inverse[:n])
