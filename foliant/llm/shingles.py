"""Hashes of five-word shingles."""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np

#: Words in a shingle.
WIDTH = 5
#: Words that are hashed at a time.
BLOCK = 1 << 16
#: Longer words are hashed one by one.
LONG = 1 << 12

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_POWERS = np.cumprod(np.full(LONG, 0x5851F42D4C957F2D, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@cache
def _letters() -> np.ndarray:
    """Which code points are letters, digits or underscores."""
    out = np.zeros(0x110001, dtype=bool)
    for run in re.finditer(r"\w+", "".join(map(chr, range(0x110000)))):
        out[run.start() : run.end()] = True
    return out


class Shingler:
    """Distinct shingles of a text in ascending order of their hash, and how often each occurs.

    Words are runs of letters, digits and underscores in lower case.  A text of
    fewer than five words is one shingle; a text without words has none.
    """

    def __init__(self):
        self.letters = _letters()

    def words(self, text: str) -> np.ndarray:
        """Hashes of the words in order, polynomials of their code points."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        inside = np.zeros(len(codes) + 2, dtype=bool)
        np.take(self.letters, codes, out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        out = []
        for k in range(0, len(edges), 2 * BLOCK):
            starts, ends = edges[k : k + 2 * BLOCK : 2], edges[k + 1 : k + 2 * BLOCK : 2]
            sizes = ends - starts
            first = np.cumsum(sizes) - sizes
            own = codes[starts[0] : ends[-1]][inside[starts[0] + 1 : ends[-1] + 1]]
            place = np.arange(len(own)) - np.repeat(first, sizes)
            h = np.add.reduceat(own * np.take(_POWERS, place, mode="clip"), first)
            for j in np.flatnonzero(sizes > LONG):
                h[j] = int.from_bytes(hashlib.blake2b(codes[starts[j] : ends[j]].tobytes(), digest_size=8).digest(), "little")
            out.append(h)
        return mix(np.concatenate(out)) if out else np.zeros(0, np.uint64)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        h = self.words(text)
        n = len(h)
        if not n:
            return h, np.zeros(0, np.int64)
        width = min(n, WIDTH)
        s = np.full(n - width + 1, width, dtype=np.uint64)
        for k in range(width):
            s += h[k : n - width + 1 + k] * _ODD[k]
        s = mix(s)
        s.sort()
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        return s[first], np.diff(first, append=len(s))
