"""Vectorised scanning of UTF-8 bytes: spans, span hashes, safe token units.

A batch of texts is one byte buffer in which every text is followed by one
``\\n``; everything after that is numpy arithmetic over the whole buffer, so the
cost per text is small and memory is bounded by the buffer's size.  Span hashes
are polynomials over the field of 2**61 - 1 elements at a random point: two different
spans of n bytes are equal at n of its points at most, so no form of text makes them
collide, unlike sums modulo 2**64.  Where a collision would merge texts, callers
take two points (122 bits) or compare the bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes put into one buffer before it is processed; one longer text makes a longer buffer.
BLOCK_BYTES = 2 << 20
#: The field's size, and the points at which the polynomials are taken.
FIELD = (1 << 61) - 1
_rng = np.random.Generator(np.random.PCG64(20240229))
POINTS = tuple(int(x) for x in _rng.integers(1 << 60, FIELD, 2))
#: Bytes or spans that are worked on at once, few enough for the processor's cache; sums are reduced as often.
_STRETCH = 1 << 15

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE_VALUES = np.arange(1, 257, dtype=np.uint64)
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[0x41:0x5B] += 32
LOWER_VALUES = BYTE_VALUES[LOWER_BYTES]

_powers: dict[int, np.ndarray] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1."""
    x = (x & np.uint64(FIELD)) + (x >> np.uint64(61))
    return x - np.uint64(FIELD) * (x >= np.uint64(FIELD))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1 of reduced numbers, in halves of 31 bits: 2**62 is 2, 2**61 is 1."""
    low, half = np.uint64((1 << 31) - 1), np.uint64(31)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half) + a0 * b0)


def _power_table(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ...: n powers in the field."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate((have, _product(have, np.uint64(pow(base, len(have), FIELD)))))
        if n <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The bijective finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanSums:
    """Prefix sums of a buffer, from which any span's hash is had: equal for equal bytes wherever they stand."""

    def __init__(self, buffer: np.ndarray, values: np.ndarray = BYTE_VALUES, point: int = 0):
        n = len(buffer)
        power = _power_table(POINTS[point], n)
        # Powers are split in two so that the sums stay whole numbers below 2**64 over a stretch.
        self._high, self._low = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        for i in range(0, n, _STRETCH):
            j = min(i + _STRETCH, n)
            own = values[buffer[i:j]]
            for sums, part in ((self._high, power[i:j] >> np.uint64(30)), (self._low, power[i:j] & np.uint64((1 << 30) - 1))):
                np.cumsum(own * part, out=sums[i + 1 : j + 1])
                sums[i + 1 : j + 1] += np.uint64(int(sums[i]) % FIELD)
        self._inverse = _power_table(pow(POINTS[point], -1, FIELD), n + 1)

    def _part(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        high, low = (_reduced(_reduced(s[ends]) + (np.uint64(FIELD) - _reduced(s[starts]))) for s in (self._high, self._low))
        high = ((high & np.uint64((1 << 31) - 1)) << np.uint64(30)) + (high >> np.uint64(31))  # times 2**30
        own = _product(_reduced(high + low), self._inverse[starts])
        return mix(own + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit number for each span buffer[start:end]."""
        out = np.empty(len(starts), np.uint64)
        for i in range(0, len(starts), _STRETCH):
            out[i : i + _STRETCH] = self._part(starts[i : i + _STRETCH], ends[i : i + _STRETCH])
        return out


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES, point: int = 0) -> np.ndarray:
    """A 64-bit hash of each span buffer[start:end]."""
    return SpanSums(buffer, values, point).hashes(starts, ends)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all spans one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def blocks(sizes: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts rows into runs [i, j) of at most limit bytes, or of one longer row."""
    i, n = 0, len(sizes)
    total = np.concatenate(([0], np.cumsum(sizes + 1)))
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, "right")) - 1)
        yield i, j
        i = j


def utf8(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as one large_binary array, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "").cast(pa.large_binary())


class Block:
    """Texts i..j of a batch in one buffer; text k is buffer[begin[k]:end[k]], and buffer[end[k]] is a line end."""

    def __init__(self, column: pa.Array, i: int, j: int):
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset + i : column.offset + j + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        rows = j - i
        sizes = np.diff(offsets)
        self.first, self.rows, self.sizes = i, rows, sizes
        self.begin = offsets[:-1] - offsets[0] + np.arange(rows)
        self.end = self.begin + sizes
        self.buffer = np.insert(data, offsets[1:] - offsets[0], 0x0A) if rows else np.zeros(0, np.uint8)

    def raw(self, k: int) -> bytes:
        return self.buffer[self.begin[k] : self.end[k]].tobytes()

    def text(self, k: int) -> str:
        return self.raw(k).decode()

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        """The text in which each position stands."""
        return np.searchsorted(self.begin, positions, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of non-space bytes."""
        word = np.concatenate(([False], ~SPACE[self.buffer], [False]))
        edges = np.flatnonzero(word[1:] != word[:-1])
        return edges[::2], edges[1::2]

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends (without the line end) of the lines of each text."""
        ends = np.flatnonzero(self.buffer == 0x0A)
        return np.concatenate(([0], ends[:-1] + 1)), ends


def text_blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterable[Block]:
    column = utf8(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    for i, j in blocks(np.diff(offsets), limit):
        yield Block(column, i, j)
