"""Vectorised word kernel shared by the text operators of this subpackage.

A batch of texts is one UTF-8 byte buffer with offsets (the layout of an Arrow
string column), so words, word hashes and hashes of word windows come from a
few numpy passes over the bytes and no Python object is made per word.

Hashes are 64-bit: a random value per byte weighted by a power of an odd base,
summed per word, mixed with the word's length; windows are summed the same way
over word hashes.  Equal words (windows) have equal hashes in every process and
on every machine; two different ones collide with a chance near 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MASK = (1 << 64) - 1
_BASE, _WBASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
CHUNK_BYTES = 1 << 20
#: Powers that a worker keeps; longer runs get theirs anew.
_KEPT_POWERS = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over unsigned 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand up to a bound."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def _first(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, b, U64)])) for b in (self.base, self.inverse))

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > _KEPT_POWERS:
            return self._first(n)
        if len(self.up) < n:
            self.up, self.down = self._first(min(max(n, 2 * len(self.up), 1 << 12), _KEPT_POWERS))
        return self.up, self.down


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(_WBASE)
_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))


class Alphabet:
    """Which bytes part words, and whether A-Z counts as a-z."""

    def __init__(self, separators: bytes, fold: bool):
        self.is_word = np.ones(256, bool)
        self.is_word[list(separators)] = False
        self.values = _BYTE_VALUES.copy()
        if fold:
            self.values[65:91] = self.values[97:123]


#: Words between the six ASCII white-space bytes.
SPACED = Alphabet(b" \t\n\x0b\x0c\r", fold=False)
SPACED_FOLDED = Alphabet(b" \t\n\x0b\x0c\r", fold=True)
#: Words of letters and digits; bytes from 0x80 count as letters.
ALNUM_FOLDED = Alphabet(bytes(b for b in range(128) if not chr(b).isalnum()), fold=True)


def _run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes; runs come in order."""
    low = int(starts[0])
    part = data[low : int(ends[-1])]
    up, down = _BYTE_POWERS.get(len(part) + 1)
    sums = np.zeros(len(part) + 1, U64)
    np.cumsum(values[part] * up[: len(part)], out=sums[1:])
    a, b = starts - low, ends - low
    return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U64) * U64(0x2545F4914F6CDD1D))


class Words:
    """The words of a few texts.

    starts, ends: byte positions in ``data``; hashes: one per word;
    bounds: the words of text i are ``bounds[i]:bounds[i + 1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet):
        n = len(data)
        self.data = data
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = alphabet.is_word[data]
        change = inside[1:] != inside[:-1]
        # a text's end parts words even where no separator stands
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        joined = np.unique(cuts[inside[cuts] & inside[cuts + 1]]) if len(cuts) else cuts
        edges = np.flatnonzero(change)
        if len(joined):
            edges = np.sort(np.concatenate([edges, joined, joined]))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hashes = np.empty(len(self.starts), U64)
        at = 0
        while at < len(self.starts):  # a block of words at a time, so that a long text takes little more memory than its words
            after = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + CHUNK_BYTES, "right")))
            self.hashes[at:after] = _run_hashes(data, self.starts[at:after], self.ends[at:after], alphabet.values)
            at = after

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of first word, hash) of each run of n words inside one text."""
        total = len(self.hashes)
        if total < n:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        up, down = _WORD_POWERS.get(total + 1)
        sums = np.zeros(total + 1, U64)
        np.cumsum(self.hashes * up[:total], out=sums[1:])
        counts = np.diff(self.bounds)
        last = np.repeat(self.bounds[1:], counts)  # end of the text of each word
        first = np.flatnonzero(np.arange(total) + n <= last)
        return first, mix((sums[first + n] - sums[first]) * down[first] + U64(n))

    def span_hashes(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Hash of each word run first:after, equal to windows() for equal words."""
        total = len(self.hashes)
        up, down = _WORD_POWERS.get(total + 1)
        sums = np.zeros(total + 1, U64)
        np.cumsum(self.hashes * up[:total], out=sums[1:])
        return mix((sums[after] - sums[first]) * down[first] + (after - first).astype(U64))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts of about ``size`` bytes."""
    data, offsets = text_buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def trimmed(run):
    """``run`` for mapInArrow, with the memory that it no longer uses given back when a task ends: workers live on."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    """Returns freed memory of this process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
