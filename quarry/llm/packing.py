"""Packing token sequences by minimum bin slack."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import Pieces
from .words import trimmed

#: Tokens a task holds before it packs them, and what it leaves for the next such block.
BLOCK_TOKENS, RESERVE_TOKENS = 1 << 21, 1 << 17
#: Texts, and their bytes, that are split into pieces together.
_TEXTS, _BYTES = 256, 1 << 20


def fill(counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """(slack, lengths used with their counts) of the multiset that fills ``room`` most closely.

    A bit of ``reach`` says that its index is a sum of lengths; each length, longest
    first, widens it by its count; counts are found again from the last length back.
    """
    lengths = sorted((x for x, c in counts.items() if c and x <= room), reverse=True)
    mask = (1 << (room + 1)) - 1
    reach, before = 1, []
    for x in lengths:
        before.append(reach)
        left, step = min(counts[x], room // x), 1
        while left > 0:
            take = min(step, left)
            reach |= (reach << (x * take)) & mask
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    used, at = {}, best
    for x, old in zip(reversed(lengths[: len(before)]), reversed(before), strict=True):
        k = 0
        while not old >> at & 1:
            at, k = at - x, k + 1
        if k:
            used[x] = k
    return room - best, used


class Packer:
    """Fills windows of ``size`` tokens; every window it closes is full, but for powers of two at the end."""

    def __init__(self, size: int):
        self.size, self.total, self.sequence = size, 0, 0
        self.lots: dict[int, list[tuple]] = {}

    def add(self, doc: tuple, ids: np.ndarray) -> Iterator[tuple]:
        """Takes a document; its full windows come out at once."""
        whole = len(ids) // self.size * self.size
        for start in range(0, whole, self.size):
            yield (doc, start, ids[start : start + self.size], len(ids), self.sequence, 0)
            self.sequence += 1
        if whole < len(ids):
            self._put((doc, whole, ids[whole:], len(ids)))

    def _put(self, piece: tuple) -> None:
        self.lots.setdefault(len(piece[2]), []).append(piece)
        self.total += len(piece[2])

    def _take(self, length: int) -> tuple:
        lot = self.lots[length]
        piece = lot.pop()
        if not lot:
            del self.lots[length]
        self.total -= length
        return piece

    def _cut(self, room: int) -> tuple:
        """The first ``room`` tokens of the shortest piece that is longer; the rest goes back."""
        doc, start, ids, n = self._take(min(x for x in self.lots if x > room))
        self._put((doc, start + room, ids[room:], n))
        return doc, start, ids[:room], n

    def close(self, room: int) -> Iterator[tuple]:
        """One sequence of exactly ``room`` tokens: the longest piece, then the subset of least slack, then a cut."""
        offset, pieces = 0, []
        longest = max((x for x in self.lots if x <= room), default=0)
        if longest:
            pieces.append(self._take(longest))
        slack, used = fill({x: len(v) for x, v in self.lots.items()}, room - longest) if room > longest else (0, {})
        for x, k in used.items():
            pieces += [self._take(x) for _ in range(k)]
        if slack:
            pieces.append(self._cut(slack))
        for doc, start, ids, n in pieces:
            yield doc, start, ids, n, self.sequence, offset
            offset += len(ids)
        self.sequence += 1

    def pack(self, leave: int) -> Iterator[tuple]:
        while self.total >= max(leave, self.size):
            yield from self.close(self.size)

    def end(self) -> Iterator[tuple]:
        """What is left, in full windows and then in windows of falling powers of two, which need no padding."""
        yield from self.pack(0)
        for bit in reversed(range(self.total.bit_length())):
            if self.total >> bit & 1:
                yield from self.close(1 << bit)


_PIECES: dict[tuple, Pieces] = {}


def _pieces(paths: tuple[str, str, str]) -> Pieces:
    """One per worker process: its memory of words, of a fixed size, outlives a task."""
    if paths not in _PIECES:
        _PIECES[paths] = Pieces(*paths)
    return _PIECES[paths]


def _pack(size: int, paths: tuple[str, str, str], end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, packer = _pieces(paths), Packer(size)
        base = TaskContext.get().partitionId() << 34
        end = np.array([end_id], np.uint32)
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            doc, start, ids, n, sequence, offset = zip(*out, strict=True)
            rows = pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                 pa.array(n, pa.int64()), pa.array([base + x for x in sequence], pa.int64()), pa.array(offset, pa.int64())],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            out.clear()
            return rows

        for rows in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(rows.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < rows.num_rows:
                room = _BYTES + (sizes[at - 1] if at else 0)
                after = min(at + _TEXTS, max(at + 1, int(np.searchsorted(sizes, room, "right"))))
                docs = rows.column(0).slice(at, after - at).to_pylist()
                texts = [x or "" for x in rows.column(1).slice(at, after - at).to_pylist()]
                at = after
                for doc, ids in zip(docs, pieces.encode(texts), strict=True):
                    out += packer.add(doc, np.concatenate([ids, end]))
                if packer.total > BLOCK_TOKENS:
                    out += packer.pack(RESERVE_TOKENS)
                if len(out) > 2000:
                    yield batch()
        out += packer.end()
        if out:
            yield batch()

    return run


def default_paths() -> tuple[str, str, str]:
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def pack(docs: DataFrame, *, size: int = 2048, end_id: int = 1, text: str = "text", id: str = "doc_id", paths: tuple[str, str, str] | None = None) -> DataFrame:
    """Pieces of all documents in sequences of ``size`` tokens: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` holds little-endian unsigned 32-bit ids.  A document is its ids (no
    added tokens) and then ``end_id``.  Full windows of a long document stand alone;
    what is left of each document goes whole into a window chosen by minimum bin
    slack, and is cut only where no subset fills the window.  Each task packs its own
    rows, about BLOCK_TOKENS at a time: nothing is shuffled and memory is bounded by
    the block and the longest text.  The last tokens of a task form sequences of
    falling powers of two, so no sequence needs padding.  ``sequence_id`` is unique, not dense.

    ``paths`` names the tokenizer file, the same vocabulary as ranks, and its
    pattern: merges run once per distinct piece of text.

    Edge cases: null and empty texts are the one id ``end_id``; repeated rows are
    packed each for itself; a null id stays null; an empty table gives no piece;
    other columns of ``docs`` are not read.
    """
    return docs.select(F.col(id).cast("long"), F.col(text)).mapInArrow(
        trimmed(_pack(size, paths or default_paths(), end_id)), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
