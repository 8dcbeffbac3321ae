"""64-bit hashes of words and word runs, over the bytes of many texts at once.

A word's hash is the difference of two prefix sums of table[byte] * base^position, divided by
base^start; base is odd, so the division is exact modulo 2^64. All steps are numpy passes.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_MIX = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U64(1)

#: A to Z in lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that separate words: space and U+0009 to U+000D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^n modulo 2^64; the longest table so far is kept."""
    if len(_powers.get(base, ())) <= n:
        out = np.full(max(n, 1 << 21) + 1, U64(base))
        out[0] = 1
        _powers[base] = np.cumprod(out, dtype=np.uint64)
    return _powers[base][: n + 1]


class Words:
    """The words of a run of texts: where they start and end, and the texts they belong to."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE, lower: np.ndarray = LOWER):
        self.data = data = lower[data]
        inside = ~separator[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]  # a word never crosses from one text to the next
        begins[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        #: Of each text, the range of its words.
        self.first = np.searchsorted(self.starts, offsets[:-1], side="left")
        self.last = np.searchsorted(self.starts, offsets[1:], side="left")
        n = len(data)
        up = powers(_BASE, n)
        self._prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[:-1], out=self._prefix[1:], dtype=np.uint64)
        self._down = powers(_INVERSE, n)[self.starts] if len(self.starts) else np.zeros(0, np.uint64)

    def hashes(self, length: int | None = None) -> np.ndarray:
        """Of each word, or of its first ``length`` bytes (fewer for shorter words)."""
        ends = self.ends if length is None else np.minimum(self.starts + length, self.ends)
        return mix((self._prefix[ends] - self._prefix[self.starts]) * self._down + (ends - self.starts).astype(np.uint64) * _MIX[60])


def runs(words: np.ndarray, first: int, last: int, size: int) -> np.ndarray:
    """The hashes of all runs of ``size`` words in words[first:last]; of the whole sequence if it is shorter, but not empty."""
    n = last - first
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(n, size)
    w = words[first:last]
    out = np.full(n - k + 1, _MIX[k], np.uint64)
    for j in range(k):
        out += w[j : j + n - k + 1] * _MIX[8 + j]
    return mix(out)
