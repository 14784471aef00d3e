"""Vectorised 64-bit hashes of words and word windows.

Words are runs of bytes other than space and \\x09-\\x0D after lower-casing A-Z, which is what
``bytes.lower`` and ``bytes.split`` do on UTF-8, so texts are never decoded.  A word's hash is a
polynomial over its bytes taken from one running sum over the batch; windows combine the mixed
word hashes, so the cost is a few numpy passes over the bytes.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240517)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_COEF = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and doubled when a longer text comes."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and the number of words of each text."""
    words = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    buf = b" ".join(b" ".join(w) for w in words if w)
    if not buf:
        return np.empty(0, np.uint64), counts
    raw = np.frombuffer(buf, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(raw)]))
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[raw] * _power_table(_BASE, len(raw)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power_table(_BASE_INV, len(raw))[starts]), counts


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's ``width``-word shingles, concatenated, and set sizes.

    A text of fewer words has its whole word sequence as the one shingle; one without words has none.
    """
    hashes, counts = word_hashes(texts)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    full = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for j in range(width):
        full += hashes[j : j + len(full)] * _COEF[j]
    full = mix(full)
    sets, sizes = [], np.zeros(len(texts), np.int64)
    for i, (a, n) in enumerate(zip(first.tolist(), counts.tolist(), strict=True)):
        if n == 0:
            continue
        if n < width:
            h = hashes[a : a + n] * _COEF[:n]
            own = mix(np.array([h.sum(dtype=np.uint64) ^ np.uint64(n)], np.uint64))
        else:
            own = np.sort(full[a : a + n - width + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        sets.append(own)
        sizes[i] = len(own)
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), sizes


def chunks(texts: list[bytes], max_bytes: int = 1 << 19):
    """Consecutive (start, stop) runs of texts of about ``max_bytes`` together; a longer text is alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > max_bytes:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
