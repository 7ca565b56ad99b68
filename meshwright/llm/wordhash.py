"""Vectorised splitting of UTF-8 text into words, and 64-bit hashes of words and shingles.

Hashes are polynomials modulo 2**64 over seeded random byte values, evaluated with one
running sum per slice of text, then mixed. Working memory is about 40 bytes for each
byte of the slice (or of the one document that is longer).
"""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_rng.integers(1, 1 << 62, dtype=np.uint64)) * 2 + 1 & (1 << 64) - 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(int(_rng.integers(1, 1 << 62, dtype=np.uint64)) * 2 + 1)
_powers: dict[str, np.ndarray] = {}

#: Separators of the contract's words: space and \x09 to \x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: For every byte, its lower-case form where it is A to Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit (shifts and odd products)."""
    h = h.copy()
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1); tables up to 4M entries are kept for reuse."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        seed = np.full(size, base, np.uint64)
        seed[0] = 1
        have = np.multiply.accumulate(seed)
        if size <= 4 << 20:
            _powers[name] = have
    return have[:n]


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR):
    """(starts, ends, document) of every maximal run of non-separators; none crosses documents."""
    inside = ~separator[data]
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before &= ~edge[:n]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", _BASE, len(data)), out=run[1:])
    raw = (run[ends] - run[starts]) * _power("down", _BASE_INV, len(data))[starts]
    return mix(raw ^ (ends - starts).astype(np.uint64) * _STEP)


def join_hashes(*parts: np.ndarray) -> np.ndarray:
    """A hash of a sequence of hashes; order and number matter."""
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        out = out * _STEP + p
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5, lower: bool = True) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its ``width``-word shingles.

    With fewer words than ``width`` the whole sequence is one shingle; without words
    the set is empty.
    """
    if lower:
        data = LOWER[data]
    starts, ends, doc = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    n_docs = len(offsets) - 1
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    n_words = np.diff(first)
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * n_docs
    if len(words) >= width:
        grams = join_hashes(*(words[k : len(words) - width + 1 + k] for k in range(width)))
    else:
        grams = np.zeros(0, np.uint64)
    for d in np.flatnonzero(n_words):
        a, n = first[d], n_words[d]
        if n >= width:
            out[d] = np.unique(grams[a : a + n - width + 1])
        else:
            out[d] = join_hashes(*(words[a + k : a + k + 1] for k in range(n)))
    return out
