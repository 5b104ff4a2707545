"""Vectorised words and n-gram hashes over Arrow string columns.

A word is a maximal run of word bytes of one document's UTF-8.  Words get 64-bit hashes
from a byte polynomial over random byte values, n-grams from a polynomial over word
hashes; both are prefix sums, so a batch costs a few numpy passes and no Python object
per word.  The hashes depend on nothing but the bytes: every executor makes the same.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BYTE_BASE, WORD_BASE = U(0x9E3779B97F4A7C15 | 1), U(0xD6E8FEB86659FD93 | 1)
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown when longer text needs it."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, U(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << max(16, int(n - 1).bit_length())
            self.up, self.down = (self._grow(b, size) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _grow(base: np.uint64, size: int) -> np.ndarray:
        out = np.full(size, base, U)
        out[0] = 1
        return np.multiply.accumulate(out)


BYTES, WORDS = Powers(BYTE_BASE), Powers(WORD_BASE)
with np.errstate(over="ignore"):
    BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words, and whether A-Z count as a-z."""

    word: np.ndarray
    values: np.ndarray
    lower: bool

    @classmethod
    def make(cls, is_word, lower: bool) -> Alphabet:
        word = np.array([is_word(b) for b in range(256)])
        values = BYTE_VALUES.copy()
        if lower:
            values[65:91] = values[97:123]
            word[65:91] = word[97:123]
        return cls(word, values, lower)


SPACE = frozenset([0x20, *range(0x09, 0x0E)])


def unspaced(lower: bool) -> Alphabet:
    """Words are runs without space, tab, newline, vertical tab, form feed, carriage return."""
    return Alphabet.make(lambda b: b not in SPACE, lower)


def alphanumeric() -> Alphabet:
    """Words are runs of digits, letters and all beyond ASCII, with A-Z taken as a-z."""
    return Alphabet.make(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80, True)


@dataclass
class Slice:
    """Words of documents ``first`` to ``first + n - 1`` of a batch."""

    first: int
    n: int
    text: np.ndarray
    offsets: np.ndarray  # n + 1, into text
    start: np.ndarray  # of each word, into text
    end: np.ndarray
    row: np.ndarray  # of each word, from 0 to n - 1
    hash: np.ndarray

    def bounds(self) -> np.ndarray:
        """n + 1 word numbers: where each document's words begin."""
        return np.searchsorted(self.row, np.arange(self.n + 1))

    def grams(self, size: int, powers: Powers | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers where a ``size``-gram of one document begins, and its hashes; other powers give other hashes."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        up, down = (powers or WORDS).get(len(self.hash))
        total = np.zeros(len(self.hash) + 1, U)
        np.cumsum(self.hash * up, out=total[1:])
        at = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        return at, mix((total[at + size] - total[at]) * down[at])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.zeros(1, np.int64)
    if len(column):
        offsets = np.frombuffer(where, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library: it keeps what it has
        pass


def slices(column: pa.Array, alphabet: Alphabet, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """All documents of a batch in order, about ``most`` bytes at a time; one document is never split.

    The size bounds a worker's arrays, which take some thirty times as much.
    """
    data, offsets = buffers(column)
    first, n = 0, len(column)
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield _scan(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first, alphabet)
        first = last
    give_back()


def _scan(text: np.ndarray, offsets: np.ndarray, first: int, alphabet: Alphabet) -> Slice:
    n = len(offsets) - 1
    inside = alphabet.word[text]
    edge = offsets[(offsets > 0) & (offsets < len(text))]
    begins, ends = inside.copy(), inside.copy()
    if len(text):
        begins[1:] &= ~inside[:-1]
        begins[edge] = inside[edge]
        ends[:-1] &= ~inside[1:]
        ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = BYTES.get(len(text) + 1)
    total = np.zeros(len(text) + 1, U)
    np.cumsum(alphabet.values[text] * up[:-1], out=total[1:])
    hashed = mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * U(0xC2B2AE3D27D4EB4F))
    row = np.searchsorted(offsets, start, "right") - 1
    return Slice(first, n, text, offsets, start, end, row, hashed)


def hash_words(texts: list[str], alphabet: Alphabet) -> list[np.ndarray]:
    """Word hashes of a few texts, by the same rule."""
    out: list[np.ndarray] = []
    for part in slices(pa.array(texts, pa.large_string()), alphabet):
        at = part.bounds()
        out += [part.hash[a:b] for a, b in zip(at[:-1], at[1:])]
    return out
