"""SetSketch registers over word shingles, and their joint likelihood.

A document's set holds 64-bit hashes of its distinct shingles.  Register i keeps
the least value of an exponential hash of the set's members on an exponentially
spaced, truncated scale: K_i = clip(floor(1 - log_b(min h_i)), 0, q + 1).  Since
h_i = -ln(1 - u_i) / a grows with the uniform hash u_i, the minimum is taken over
u_i first and mapped to the scale once.  Registers of a union are the maxima of the
registers (mergeable), and two sets agree in a register with a chance close to their
Jaccard similarity (locality-sensitive).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from corvane.llm.bytespans import LOWER_VALUES, Block, mix, span_hashes

REGISTERS, ROWS_PER_BAND = 128, 4
BANDS = REGISTERS // ROWS_PER_BAND
#: Scale: base b, rate a, largest register value q + 1 (fits 16 bits).
SCALE_B, RATE_A, TOP_Q = 1.001, 20.0, 65533

_rng = np.random.Generator(np.random.PCG64(977))
_FACTORS = _rng.integers(0, 1 << 64, REGISTERS, dtype=np.uint64) | np.uint64(1)
_OFFSETS = _rng.integers(0, 1 << 64, REGISTERS, dtype=np.uint64)
_LOG_B = np.log(SCALE_B)


def shingle_sets(block: Block, width: int = 2) -> Iterator[np.ndarray]:
    """For each text of the block the sorted distinct hashes of its word shingles.

    Words are runs of non-space bytes with A-Z lower-cased; a text of fewer than
    `width` words gives its whole sequence as one shingle, one without words none.
    """
    starts, ends = block.words()
    words = span_hashes(block.buffer, starts, ends, LOWER_VALUES)
    first = np.searchsorted(starts, block.begin)
    last = np.searchsorted(starts, block.end)
    grams = words.copy()
    for k in range(1, width):  # position p: the words p .. p + width - 1
        grams = grams[:-1] if k > 1 else grams
        grams = mix(grams[: len(words) - k] * np.uint64(0x9E3779B97F4A7C15) + words[k:]) if len(words) > k else grams[:0]
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        n = b - a
        if n >= width:
            s = np.sort(grams[a : b - width + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif n:
            whole = words[a : a + 1]
            for k in range(1, n):
                whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + words[a + k : a + k + 1])
            yield mix(whole + np.uint64(n))
        else:
            yield words[:0]


def registers(members: np.ndarray) -> np.ndarray:
    """The uint16 registers of a non-empty set of 64-bit hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for i in range(0, len(members), 1024):
        part = np.multiply.outer(_FACTORS, members[i : i + 1024])
        part += _OFFSETS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    h = -np.log1p(-((least >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / RATE_A
    return np.clip(np.floor(1 - np.log(h) / _LOG_B), 0, TOP_Q + 1).astype(np.uint16)


def merge(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(one, other)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One int64 per band of a sketch (or of each row of sketches): its four 16-bit registers side by side."""
    return np.ascontiguousarray(sketch).view(np.int64)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (SCALE_B - 1) / SCALE_B) / _LOG_B


def likely_jaccard(greater: np.ndarray, less: np.ndarray, n_one: np.ndarray, n_other: np.ndarray) -> np.ndarray:
    """The most likely Jaccard similarity from the counts of registers in which the
    first sketch is greater or less than the second, given both set sizes.

    Maximises greater*ln p(u - v J) + less*ln p(v - u J) + equal*ln(1 - p - p) with
    u = n_one / (n_one + n_other), v = 1 - u over J in [0, min(u/v, v/u)] by
    golden-section search on the concave log-likelihood, for all pairs at once.
    """
    u = n_one / (n_one + n_other)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    equal = REGISTERS - greater - less

    def score(j: np.ndarray) -> np.ndarray:
        p, q = _p(np.maximum(u - v * j, 1e-12)), _p(np.maximum(v - u * j, 1e-12))
        return greater * np.log(np.maximum(p, 1e-12)) + less * np.log(np.maximum(q, 1e-12)) + equal * np.log(np.maximum(1 - p - q, 1e-12))

    ratio = (np.sqrt(5) - 1) / 2
    low, high = np.zeros_like(top), top.copy()
    for _ in range(24):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        right = score(a) < score(b)
        low, high = np.where(right, a, low), np.where(right, high, b)
    return (low + high) / 2
