"""Words of whole texts as numpy arrays.

A word is a maximal run of bytes other than the six ASCII white-space bytes
(``[^\\x20\\x09-\\x0D]+``).  Words are hashed to 64 bits for a whole text at
once: prefix sums of byte values times powers of an odd base give every word's
polynomial hash without a Python loop.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1, 2**61)) * 8 + 5
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > _powers["n"]:
        n = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n + 1, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``data`` and their first bytes, in order."""
    if not data:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    buf = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~_SPACE[buf]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[0::2], edges[1::2]
    up, down = _grown(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts]), starts


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of ``data``, in order."""
    return _hashed(data)[0]


def joined_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes of many texts in one array, and where each text's words start (and the last ones end)."""
    hashes, firsts = _hashed(b"\n".join(texts))
    offsets = np.cumsum([0, *(len(x) + 1 for x in texts)])
    return hashes, np.searchsorted(firsts, offsets)


def portions(sizes: list[int], most: int = 1 << 20):
    """Ranges of consecutive texts with ``most`` bytes in all, or one longer text."""
    lo = size = 0
    for k, n in enumerate(sizes):
        if k > lo and size + n > most:
            yield lo, k
            lo, size = k, 0
        size += n
    if lo < len(sizes):
        yield lo, len(sizes)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the runs of ``n`` consecutive words (empty if fewer)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + words[k : len(words) - n + 1 + k]
    return mixed(out)
