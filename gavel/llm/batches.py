"""Arrow batches of texts cut to a bounded number of bytes, and the words in them, in NumPy.

The helpers work on the raw UTF-8 bytes of many texts at once. Memory follows the byte bound (or
one single longer text), never the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20


def text_pieces(batches: Iterator[pa.RecordBatch], text_col: str, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their texts: (rows, bytes, offsets); null texts are empty."""
    try:
        yield from _text_pieces(batches, text_col, piece_bytes)
    finally:
        release_memory()  # a worker that is reused starts its next task with what it needs only


def release_memory() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # a C library without it
    _TRIM = None


def _text_pieces(batches: Iterator[pa.RecordBatch], text_col: str, piece_bytes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text_col))
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        column = column.fill_null("")
        n, at = len(column), column.offset
        if not n:
            continue
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=at + n + 1)[at:]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + piece_bytes, side="right")) - 1)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


# --- hashes of byte ranges ----------------------------------------------------------------------
# H(s, e) = sum of (symbol i + 1) * R^(i - s) modulo the prime 2^61 - 1, read off prefix sums. Two unlike ranges of n symbols
# share a hash for at most n of the 2^61 radices R, whatever the symbols are.

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += _GOLDEN
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


PRIME = (1 << 61) - 1
_P, _LOW = np.uint64(PRIME), np.uint64(0xFFFFFFFF)
_S61, _S32, _S29, _S3, _LOW29 = np.uint64(61), np.uint64(32), np.uint64(29), np.uint64(3), np.uint64((1 << 29) - 1)
#: Symbols whose products are summed before they are reduced.
_SUMMED = 1 << 14


#: Values worked on at once, so that intermediate results stay in the cache.
_NEAR = 1 << 14


def reduce61(x: np.ndarray) -> np.ndarray:
    """Below 2^61 - 1."""
    x = (x & _P) + (x >> _S61)
    x -= _P * (x >= _P)
    return x


def _times61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a0, a1, b0, b1 = a & _LOW, a >> _S32, b & _LOW, b >> _S32
    middle, high = a0 * b1, a1 * b1
    a1 *= b0
    middle += a1
    a0 *= b0
    out = a0 & _P
    a0 >>= _S61
    out += a0
    out += middle >> _S29
    middle &= _LOW29
    middle <<= _S32
    out += middle
    high <<= _S3
    out += high
    return reduce61(out)


def times61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of values below the prime, modulo the prime; ``b`` may be one value."""
    if len(a) <= _NEAR:
        return _times61(a, b)
    out = np.empty(len(a), np.uint64)
    for at in range(0, len(a), _NEAR):
        part = slice(at, at + _NEAR)
        out[part] = _times61(a[part], b[part] if np.ndim(b) else b)
    return out


class RangeHash:
    """Hashes of ranges of an array of small symbols (bytes) or of 64-bit symbols (word hashes)."""

    def __init__(self, seed: int):
        self.radix = int(mix64(np.array([seed * 1000003], dtype=np.uint64))[0]) % (PRIME - 2) + 2
        self.inverse = pow(self.radix, -1, PRIME)
        self._powers = self._negative = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        while len(self._powers) < n:
            size = len(self._powers)
            step, back = (np.uint64(pow(r, size, PRIME)) for r in (self.radix, self.inverse))
            self._powers = np.concatenate([self._powers, times61(self._powers, step)])
            self._negative = np.concatenate([self._negative, times61(self._negative, back)])

    def prefixes(self, symbols: np.ndarray) -> np.ndarray:
        self._grow(len(symbols) + 1)
        out = np.zeros(len(symbols) + 1, np.uint64)
        for a in range(0, len(symbols), _SUMMED):
            part = symbols[a : a + _SUMMED]
            powers = self._powers[a : a + len(part)]
            if part.dtype == np.uint8:
                value = part.astype(np.uint64) + np.uint64(1)
                low, high = np.cumsum((powers & _LOW) * value), np.cumsum((powers >> _S32) * value)
            else:
                value = times61(reduce61(part), powers)
                low, high = np.cumsum(value & _LOW), np.cumsum(value >> _S32)
            # low and high sums stay below 2^63; 2^32 * high is split like a middle product
            whole = reduce61((low & _P) + (low >> _S61) + (high >> _S29) + ((high & _LOW29) << _S32))
            out[a + 1 : a + 1 + len(part)] = reduce61(whole + out[a])
        return out

    def ranges(self, prefixes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(prefixes))
        out = np.empty(len(starts), np.uint64)
        for at in range(0, len(starts), _NEAR):
            a, b = starts[at : at + _NEAR], ends[at : at + _NEAR]
            out[at : at + _NEAR] = mix64(_times61(reduce61(prefixes[b] + (_P - prefixes[a])), self._negative[a]))
        return out


BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_WORD = RangeHash(1)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a piece: byte ``start`` and ``end``, the ``doc`` (row of
    the piece), 64-bit ``hash``; ``first[d]`` is the first word of row d (length rows + 1)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        blank = BLANK[data]
        begins = ~blank
        begins[1:] &= blank[:-1]
        ends = ~blank
        ends[:-1] &= blank[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begins[inner] = ~blank[inner]  # a text's start and end cut words
        ends[inner - 1] = ~blank[inner - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hash = _WORD.ranges(_WORD.prefixes(LOWER[data] if lower else data), self.start, self.end)


_GRAM = RangeHash(2)


def word_windows(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """All runs of ``length`` words inside one text: (index of the first word, hash)."""
    at = np.arange(len(words.start))
    at = at[at + length <= words.first[words.doc + 1]]
    if not len(at):
        return at, np.zeros(0, np.uint64)
    return at, _GRAM.ranges(_GRAM.prefixes(words.hash), at, at + length)


def word_runs(words: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the word ranges [first, last)."""
    return _GRAM.ranges(_GRAM.prefixes(words.hash), first, last)
