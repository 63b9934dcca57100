"""Word shingles of whole texts as 64-bit hashes, computed over a batch's bytes with numpy."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_rng = np.random.Generator(np.random.PCG64(7))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
EXACT = _BYTE.copy()  # for hashes that tell capitals apart
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """s with (s[b] - s[a]) * inverse power a = hash of data[a:b]."""
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(len(data))[0], out=s[1:])
    return s


def words(data: np.ndarray, at: np.ndarray, gap: np.ndarray = _GAP):
    """Hashes, starts, ends of all words in ``data`` (texts at ``at``), and each text's first word."""
    inside = ~gap[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = at[:-1][at[:-1] < len(data)]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = at[1:][at[1:] > 0] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    s = prefix_hash(data)
    h = mix((s[end] - s[start]) * powers(len(data) + 1)[1][start] + (end - start).astype(np.uint64))
    return h, start, end, np.searchsorted(start, at)


def spans(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words (runs over a text's end included; the caller cuts)."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    n = len(h) - size + 1
    out = h[:n].copy()
    for j in range(1, size):
        out = out * _BASE + h[j:j + n]
    return mix(out)


def sets(data: np.ndarray, at: np.ndarray, size: int):
    """For each text the sorted distinct hashes of its ``size``-word shingles; a text with fewer
    words has its whole sequence as the one shingle, a text without words none."""
    h, _, _, first = words(data, at)
    runs = spans(h, size)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            yield np.unique(runs[a:b - size + 1])
        elif b > a:
            x = np.uint64(b - a)
            for w in h[a:b]:
                x = mix(np.array([x * _BASE + w], np.uint64))[0]
            yield np.array([x], np.uint64)
        else:
            yield np.zeros(0, np.uint64)
