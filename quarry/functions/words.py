"""Words of Arrow arrays of texts, those that text.tokens() gives of a column: a few passes over the bytes, no object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import STOP_WORDS

#: Bytes of text that are looked at together.
CHUNK = 1 << 21
STOP = pa.array(sorted(set(STOP_WORDS)), pa.large_string())

_BYTES = np.arange(256, dtype=np.uint8)
_LETTER = ((_BYTES | 32) >= ord("a")) & ((_BYTES | 32) <= ord("z"))
_WORD = _LETTER | ((_BYTES >= ord("0")) & (_BYTES <= ord("9")))
_LOWER = np.where(_LETTER, _BYTES | 32, _BYTES).astype(np.uint8)


def _offsets(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts without nulls, and where each begins in their bytes."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    return whole, np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)


def slices(texts: pa.Array, most: int = 1 << 62) -> Iterator[tuple[int, int]]:
    """(from, to) of texts of about CHUNK bytes together, ``most`` at most and one at least."""
    _, off = _offsets(texts)
    a = 0
    while a < len(texts):
        b = min(a + most, max(a + 1, int(np.searchsorted(off, off[a] + CHUNK, "right")) - 1))
        yield a, b
        a = b


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(word, place of its text) of all texts, in order: stop words are left in; null has none."""
    whole, off = _offsets(texts)
    size = int(off[-1] - off[0])
    if not size:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    raw, off = np.frombuffer(whole.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]
    inside, edge = _WORD[raw], np.zeros(size + 1, bool)
    edge[off] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    digits = np.flatnonzero(~_LETTER[raw[start]])  # a word begins with the first letter of its run
    if len(digits):
        letters = np.append(np.flatnonzero(_LETTER[raw]), size)
        start[digits] = np.minimum(letters[np.searchsorted(letters, start[digits])], end[digits])
    long = end - start >= 3
    start, end = start[long], end[long]
    turn = np.zeros(size + 1, np.int8)
    turn[start] += 1
    turn[end] -= 1
    bytes_ = _LOWER[raw[np.cumsum(turn[:-1], dtype=np.int8).astype(bool)]]
    ends = np.append(0, np.cumsum(end - start))
    found = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(bytes_)])
    return found, np.searchsorted(off, start, "right") - 1


def known(terms: pa.Array) -> pa.Array:
    """What places() looks for: terms, which are no stop words, and then the stop words."""
    return pa.concat_arrays([terms.cast(pa.large_string()), STOP])


def places(texts: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term) of each word that is a term, and how many words each text has without stop words."""
    found, at = words(texts)
    place, size = pc.fill_null(pc.index_in(found, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64), len(known) - len(STOP)
    met = (place >= 0) & (place < size)
    return at[met], place[met], np.bincount(at[place < size], minlength=len(texts))


def counted(shared, totals: bool):
    """A map of texts to (term, df, words), to be summed by term: the texts with each of the terms that ``shared`` holds; with totals, all texts and their words in a row without a term."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        looked, n, total, df = known(terms), 0, 0, np.zeros(len(terms), np.int64)
        for batch in batches:
            texts = batch.column(0)
            n += len(texts)
            for a, b in slices(texts):
                row, term, long = places(texts.slice(a, b - a), looked)
                met = np.sort(row * len(terms) + term)
                df += np.bincount(met[np.append(True, met[1:] > met[:-1])[: len(met)]] % max(1, len(terms)), minlength=len(terms))
                total += int(long.sum())
        some = np.flatnonzero(df)
        for a in range(0, len(some), 1 << 16):
            s = some[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(s)), pa.array(df[s]), pa.nulls(len(s), pa.int64())], names=["term", "df", "words"])
        if totals:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["term", "df", "words"])

    return each
