"""Words and word shingles of many texts at once, as 64-bit hashes.

A word is a run of bytes other than the six ASCII blanks (space, tab to carriage return), with A-Z in lower case.
Hashes are polynomials modulo 2**64 whose prefix sums give every word by one subtraction.
"""

import numpy as np

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)
LOWER += np.uint64(1)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        _powers[base] = np.cumprod(known)
    return _powers[base][:n]


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[starts[i]:ends[i]], equal for equal content wherever it stands."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=sums[1:])
    length = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(values) + 1)[starts] + length * _M2)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): words in all texts; those of text i are first[i]:first[i + 1]."""
    solid = ~BLANK[data]
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]  # a word never crosses texts
    begins[inner] = solid[inner]
    stops[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the word hashes of all texts; those of text i are first[i]:first[i + 1]."""
    starts, ends, first = word_spans(data, offsets)
    return range_hash(LOWER[data], starts, ends), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text): runs of ``size`` words of each text; a shorter text gives its whole sequence, an empty one nothing."""
    counts = np.diff(first)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    text = np.repeat(np.arange(len(counts)), made)
    start = np.arange(len(text)) - np.repeat(np.cumsum(made) - made, made) + first[:-1][text]
    if len(words) == 0:
        return np.zeros(0, np.uint64), text
    return range_hash(words, start, start + np.minimum(size, counts[text])), text


def distinct(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs, sorted by both."""
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], text[new]
