"""Substring deduplication by super-k-mer partitioning."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import boxed, kept, release
from .words import SPACED, Words, chunks, trimmed

#: Words of a minimiser.
MINIMISER = 6
#: Super-k-mers of one minimiser that one task sorts; a more frequent minimiser is salted.
GROUP_ROWS = 20_000
_BLOCK_BYTES = 1 << 20


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of each run of ``width`` values."""
    best, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = slice(0, len(best) - step), slice(step, len(best))
        take = best[right] < best[left]
        at = np.where(take, at[right], at[left])
        best = np.where(take, best[right], best[left])
        span += step
    return at


def super_kmers(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, windows) of the runs of windows that share a minimiser's place."""
    size = min(MINIMISER, window)
    place, mers = w.windows(size)
    first, _ = w.windows(window)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at_word = np.full(len(w.hashes), np.iinfo(np.uint64).max, np.uint64)
    at_word[place] = mers
    at = _leftmost_minimum(at_word, window - size + 1)[first]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (first[1:] != first[:-1] + 1)])
    start = np.flatnonzero(new)
    return at_word[at[start]], first[start], np.diff(np.concatenate([start, [len(first)]]))


def _occurrences(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, _, data, offsets in chunks(batch.column(2)):
                w = Words(data, offsets, SPACED)
                mer, first, n = super_kmers(w, window)
                doc = np.searchsorted(w.bounds, first, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [_as_long(mer), pa.array(ids[i + doc]), pa.array(keys[i + doc]), pa.array((first - w.bounds[doc]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["mer", "_d", "_k", "first", "n"],
                )

    return run


def _packed(window: int):
    """Super-k-mers whose minimiser recurs, as strings of words parted by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            use = np.flatnonzero(~np.asarray(column["runs"].is_null()))
            out = []
            for row in use:
                words = (column["_text"][int(row)].as_py() or "").encode().split()
                d, k = column["_d"][int(row)].as_py(), column["_k"][int(row)].as_py()
                out += [(r["mer"], r["salts"], d, k, r["first"], b" ".join(words[r["first"] : r["first"] + r["n"] + window - 1])) for r in column["runs"][int(row)].as_py()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)],
                names=["mer", "salts", "_d", "_k", "first", "packed"],
            )

    return run


class _Sorted:
    """Counts the windows of one or more whole groups of super-k-mers by sorting."""

    def __init__(self, window: int):
        self.window = window

    def count(self, rows: pa.RecordBatch | pa.Table) -> pa.RecordBatch | None:
        table = pa.Table.from_batches([rows]) if isinstance(rows, pa.RecordBatch) else rows
        packed = table["packed"].combine_chunks()
        packed = pa.concat_arrays(packed.chunks) if isinstance(packed, pa.ChunkedArray) else packed
        offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
        data = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        w = Words(data, offsets - offsets[0], SPACED)
        first, h = w.windows(self.window)
        if not len(first):
            return None
        other = np.zeros(len(w.hashes) + 1, np.uint64)
        np.cumsum((w.hashes ^ (w.hashes << np.uint64(17))) * _MULTIPLIERS.get(len(w.hashes)), out=other[1:])
        row = np.searchsorted(w.bounds, first, "right") - 1
        second = (other[first + self.window] - other[first]) * _MULTIPLIERS.inverse(len(w.hashes))[first]
        mer, salts = table["mer"].to_numpy()[row], table["salts"].to_numpy()[row]
        order = np.lexsort((second, h, mer))
        a, b, c = mer[order], h[order], second[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
        start = np.flatnonzero(new)
        count = np.diff(np.concatenate([start, [len(a)]]))
        each = np.empty(len(a), np.int64)
        each[order] = np.repeat(count, count)
        place = table["first"].to_numpy()[row] + (first - w.bounds[row])
        # windows seen twice here are settled; one row of each distinct window of a salted group goes on
        pieces = []
        twice = np.flatnonzero(each > 1)
        if len(twice):
            joins = np.concatenate([[True], (row[twice][1:] != row[twice][:-1]) | (place[twice][1:] != place[twice][:-1] + 1)])
            s = np.flatnonzero(joins)
            pieces.append((row[twice[s]], place[twice[s]], np.diff(np.concatenate([s, [len(twice)]])), np.zeros(len(s), np.uint64), np.zeros(len(s), np.uint64), np.zeros(len(s), np.int32)))
        one = order[start]
        one = one[salts[one] > 1]
        if len(one):
            pieces.append((row[one], place[one], np.ones(len(one), np.int64), h[one], second[one], np.minimum(each[one], 2).astype(np.int32)))
        if not pieces:
            return None
        at, place, n, h1, h2, seen = (np.concatenate(x) for x in zip(*pieces, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(table["_d"].to_numpy()[at]), pa.array(table["_k"].to_numpy()[at]), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32)), _as_long(h1), _as_long(h2), pa.array(seen)],
            names=["_d", "_k", "first", "n", "h1", "h2", "seen"],
        )


class _Multipliers:
    def __init__(self):
        self.base = 0xAF251AF3B0F025B5
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, self.base, np.uint64)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, pow(self.base, -1, 1 << 64), np.uint64)]))

    def get(self, n: int) -> np.ndarray:
        self._grow(n)
        return self.up[:n]

    def inverse(self, n: int) -> np.ndarray:
        self._grow(n)
        return self.down[:n]


_MULTIPLIERS = _Multipliers()


def _counted(window: int):
    """Groups come sorted by (mer, salt); whole groups are counted together, about a megabyte at a time.

    A group holds at most GROUP_ROWS super-k-mers in expectation, as frequent minimisers are salted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, held = _Sorted(window), []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held).combine_chunks()
            mer, salt = rows["mer"].to_numpy(), rows["salt"].to_numpy()
            ends = np.flatnonzero((mer[1:] != mer[:-1]) | (salt[1:] != salt[:-1])) + 1
            if not len(ends):
                continue
            yield from _blocks(counter, rows.slice(0, int(ends[-1])), ends)
            held = rows.slice(int(ends[-1])).to_batches()
        if held:
            out = counter.count(pa.Table.from_batches(held).combine_chunks())
            if out is not None:
                yield out

    return run


def _blocks(counter: _Sorted, rows: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts rows in runs of whole groups; a salted group is counted alone, so that its salts stay apart."""
    salts = rows["salts"].to_numpy()
    size = np.cumsum(np.fromiter((x.as_py() for x in pa.compute.binary_length(rows["packed"])), np.int64, rows.num_rows))
    at = 0
    for k, end in enumerate(ends):
        last = k == len(ends) - 1
        if last or salts[at] > 1 or salts[end] > 1 or size[end - 1] - (size[at - 1] if at else 0) > _BLOCK_BYTES:
            out = counter.count(rows.slice(at, int(end) - at))
            at = int(end)
            if out is not None:
                yield out


def _cut(window: int):
    """Rows (box, text, runs) with the words of the runs removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = batch.column(1), batch.column(2)
            n_words, n_removed, left = [], [], []
            for value, own in zip(texts, runs, strict=True):
                words = (value.as_py() or "").encode().split()
                n_words.append(len(words))
                if own.is_valid and own.as_py():
                    keep = np.ones(len(words), bool)
                    for r in own.as_py():
                        keep[r["first"] : r["first"] + r["n"] + window - 1] = False
                    words = list(compress(words, keep.tolist()))
                n_removed.append(n_words[-1] - len(words))
                left.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())],
                names=["box", "_text", "n_words", "n_removed", "kept_text"],
            )

    return run


def remove_repeats(docs: DataFrame, *, window: int = 35, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Adds n_words, n_removed and kept_text: ``docs`` without words of repeated windows.

    A window is ``window`` consecutive white-space-parted words of one text.  Each
    window has a minimiser, its run of MINIMISER words of least hash; windows in a
    row with the same minimiser form a super-k-mer.  Equal windows have equal
    minimisers, so first only (minimiser, place) is counted; super-k-mers whose
    minimiser recurs then travel as packed strings to the minimiser's bucket, where
    their windows are sorted by 128 bits of hash and counted.  A minimiser of more than
    GROUP_ROWS super-k-mers is salted by document; each salt sends one row of a
    distinct window on, and those are summed by window.

    Edge cases: null and empty texts and texts of fewer words keep all words;
    repeated rows (same id and text) count as occurrences of each other; a null id
    is an id like any other; columns of ``docs`` with the added names are replaced.
    """
    added = ("n_words", "n_removed", "kept_text")
    base, columns = boxed(docs, {"_text": text, "_d": F.coalesce(F.col(id).cast("long"), F.lit(-1)), "_k": F.xxhash64(F.col(text))}, added)
    seen = kept(base.select("_d", "_k", "_text").mapInArrow(trimmed(_occurrences(window)), "mer long, _d long, _k long, first int, n int"))
    # a table of its own, so that a join with it can split a frequent minimiser's rows
    often = kept(seen.groupBy("mer").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    runs = (
        seen.join(often.hint("merge"), "mer")
        .select("_d", "_k", F.struct("mer", F.ceil(F.col("c") / GROUP_ROWS).cast("int").alias("salts"), "first", "n").alias("run"))
        .distinct()
        .groupBy("_d", "_k")
        .agg(F.collect_list("run").alias("runs"))
    )
    runs = kept(runs)
    release(seen, often)
    with_runs = base.select("_d", "_k", "_text").join(runs, ["_d", "_k"])
    packed = with_runs.mapInArrow(trimmed(_packed(window)), "mer long, salts int, _d long, _k long, first int, packed binary")
    bucketed = packed.withColumn("salt", F.pmod(F.xxhash64("_d", "_k", "first"), F.col("salts")).cast("int"))
    counted = (
        bucketed.repartition("mer", "salt")
        .sortWithinPartitions("mer", "salt")
        .mapInArrow(trimmed(_counted(window)), "_d long, _k long, first int, n int, h1 long, h2 long, seen int")
    )
    counted = kept(counted)
    release(runs)
    settled = counted.where("seen = 0").select("_d", "_k", "first", "n")
    across = (
        counted.where("seen > 0")
        .groupBy("h1", "h2")
        .agg(F.sum("seen").alias("total"), F.collect_list(F.when(F.col("seen") == 1, F.struct("_d", "_k", "first"))).alias("at"))
        .where("total > 1")
        .select(F.explode("at").alias("x"))
        .select("x._d", "x._k", "x.first", F.lit(1).alias("n"))
    )
    covered = settled.union(across).groupBy("_d", "_k").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    schema = f"box {base.schema['box'].dataType.simpleString()}, _text string, n_words long, n_removed long, kept_text string"
    out = base.join(covered, ["_d", "_k"], "left").select("box", "_text", "runs").mapInArrow(trimmed(_cut(window)), schema)
    return out.select(*columns, *added)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
