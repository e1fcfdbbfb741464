"""Vectorised hashing of words and word windows for blocks of texts."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Separators of the plain reading: ASCII white space.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_PLAIN = bytes(range(256))
#: The folded reading: A-Z lower-cased, words of digits, letters and everything beyond ASCII.
_FOLDED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on each other."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        steps = np.full(n, _BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
        steps[1:] = _INVERSE
        _inverses = np.multiply.accumulate(steps)


def word_hashes(texts: list[bytes], folded: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after another, and the number of words of each text."""
    table = _FOLDED if folded else _PLAIN
    data = np.frombuffer(b"".join(t.translate(table) + b" " for t in texts), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    apart = WHITE[data]
    edges = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    if not apart[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[0::2], edges[1::2]
    _grow(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _powers[: len(data)], dtype=np.uint64)))
    hashes = mix((sums[ends] - sums[starts]) * _inverses[starts] + (ends - starts).astype(np.uint64))
    offsets = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, offsets), prepend=0)
    return hashes, counts.astype(np.int64)


def window_hashes(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of all runs of n words (also of runs across texts; callers leave those out)."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    own = words if not seed else mix(words + _U(seed * int(_BASE) % (1 << 64)))
    total = np.zeros(size, np.uint64)
    for k in range(n):
        total += own[k : k + size] * _U(pow(0xD6E8FEB86659FD93, k, 1 << 64))
    return mix(total)


def window_starts(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the row of all words where a window of n words of one text starts, and its text."""
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    place = np.arange(len(text)) - first[text]
    inside = place + n <= counts[text]
    return np.flatnonzero(inside), text[inside]
