"""Rolling 64-bit hashes of bytes and words, in numpy, the same in every process."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i below n, modulo 2 ** 64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, x in (("up", BASE), ("down", INVERSE)):
            step = np.full(size, x, np.uint64)
            step[0] = 1
            _POWERS[name] = np.multiply.accumulate(step)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefixes(data: np.ndarray) -> np.ndarray:
    """p with p[j] - p[i] the hash of bytes i to j, times BASE ** i."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def ranges(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the byte ranges."""
    _, down = _powers(len(p))
    return mix((p[end] - p[start]) * down[start])


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(raw: bytes) -> np.ndarray:
    """Hashes of the words between ASCII white space, in order."""
    data = np.frombuffer(raw, np.uint8)
    space = np.ones(len(data) + 2, np.int8)
    space[1:-1] = _SPACE[data]
    turn = np.diff(space)
    return ranges(prefixes(data), np.flatnonzero(turn == -1), np.flatnonzero(turn == 1))


def shingles(raw: bytes, n: int) -> np.ndarray:
    """Distinct hashes, ascending, of the windows of n words, or of all words where they are fewer."""
    words = word_hashes(raw)
    if len(words) == 0:
        return words
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(BASE) + words[i : len(words) - k + 1 + i]
    return np.unique(mix(out))
