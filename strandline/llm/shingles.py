"""Word n-grams of many texts as 64-bit numbers, a batch at a time in numpy."""

from __future__ import annotations

import numpy as np

#: A-Z become lower case, the white space of the word contracts becomes blanks, other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if "up" not in _POWERS or _POWERS["up"].size < n:
        size = max(n, 1 << 20)
        down = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", down)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and the number of words of each text."""
    raw = [t.encode("utf-8", "surrogatepass").translate(_FOLD) if t else b"" for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    inside = data != 32
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(data.size + 1)
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: data.size])
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    hashes = mix((sums[ends - 1] - before) * down[starts])
    limits = np.cumsum([len(r) + 1 for r in raw])
    counts = np.diff(np.searchsorted(starts, limits), prepend=0)
    return hashes, counts


def grams(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text, ascending within a text, and how many each has.

    A text of fewer words than ``size`` has all its words as one; a text without words has none.
    """
    hashes, counts = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(hashes.size)
    width = np.minimum(size, counts)[owner]
    at = np.flatnonzero(left >= width)
    at = at[(counts[owner[at]] >= size) | (left[at] == counts[owner[at]])]
    total = np.zeros(at.size, np.uint64)
    for k in range(size):
        use = width[at] > k
        part = mix(hashes[np.where(use, np.minimum(at + k, max(hashes.size - 1, 0)), 0)] + np.uint64((k + 1) * int(_BASE) % (1 << 64))) if at.size else total
        total = total + np.where(use, part, np.uint64(0))
    total = mix(total + width[at].astype(np.uint64))
    order = np.lexsort((total, owner[at]))
    total, owner = total[order], owner[at][order]
    new = np.append(True, (total[1:] != total[:-1]) | (owner[1:] != owner[:-1]))[: total.size]
    return total[new], np.bincount(owner[new], minlength=len(texts))
