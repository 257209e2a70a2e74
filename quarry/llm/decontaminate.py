"""Benchmark decontamination: prefix-filtered set join of item windows with documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import boxed
from .words import ALNUM_FOLDED, Words, chunks, trimmed

#: Windows of the benchmark that one pass over the documents looks for; a larger benchmark takes more passes.
BLOCK_WINDOWS = 1_000_000


@dataclass
class _Index:
    """One block of benchmark windows, arranged by the token each must be found by."""

    size: int
    lengths: list[int]
    tokens: dict[int, np.ndarray]  # shingle length -> sorted prefix tokens
    rows: dict[int, np.ndarray]  # rows of `windows` in that order
    offset: np.ndarray  # window -> place of its prefix token inside it
    width: np.ndarray  # window -> words
    whole: np.ndarray  # window -> hash of all its words
    check: np.ndarray  # window -> second hash of all its words
    item_start: np.ndarray  # window -> its items in `items`
    items: np.ndarray


def _shingle(width: int, size: int) -> int:
    return min(size, width)


def _check_sums(hashes: np.ndarray) -> np.ndarray:
    """Running sums for a second, independent hash of word runs."""
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum((hashes ^ (hashes << np.uint64(13))) * np.uint64(0xD6E8FEB86659FD93), out=out[1:])
    return out


def _windows(texts: pa.Array, width: int) -> list[tuple[int, np.ndarray]]:
    """(row, word hashes) of every window; an item of fewer words is one window."""
    out = []
    for i, j, data, offsets in chunks(texts):
        w = Words(data, offsets, ALNUM_FOLDED)
        for k in range(j - i):
            h = w.hashes[w.bounds[k] : w.bounds[k + 1]]
            if 0 < len(h) <= width:
                out.append((i + k, h))
            elif len(h):
                out += [(i + k, h[x : x + width]) for x in range(len(h) - width + 1)]
    return out


def _run_hash(w: Words, first: np.ndarray, width: int) -> np.ndarray:
    return w.span_hashes(first, first + width)


class _Plain(Words):
    """Words known by their hashes only."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray):
        self.hashes, self.bounds = hashes, bounds


def _flat(windows: list[np.ndarray]) -> _Plain:
    sizes = np.array([len(x) for x in windows], np.int64)
    return _Plain(np.concatenate(windows), np.concatenate([[0], np.cumsum(sizes)]))


def _shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    return w.windows(size)


def _count_shingles(docs: DataFrame, wanted: dict[int, np.ndarray], text: str) -> dict[int, np.ndarray]:
    """Occurrences in all documents of the wanted shingles, by shingle length."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = held.value
        sums = {k: np.zeros(len(v), np.int64) for k, v in keys.items()}
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                w = Words(data, offsets, ALNUM_FOLDED)
                for k, v in keys.items():
                    _, h = _shingles(w, k)
                    at = np.minimum(np.searchsorted(v, h), len(v) - 1)
                    sums[k] += np.bincount(at[v[at] == h], minlength=len(v))
        for k, s in sums.items():
            hit = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(hit), k, np.int32)), pa.array(hit.astype(np.int64)), pa.array(s[hit])], names=["size", "at", "n"]
            )

    rows = docs.select(text).mapInArrow(trimmed(count), "size int, at long, n long").groupBy("size", "at").agg(F.sum("n").alias("n")).collect()
    out = {k: np.zeros(len(v), np.int64) for k, v in wanted.items()}
    for r in rows:  # at most one row a shingle of this block
        out[r["size"]][r["at"]] = r["n"]
    held.unpersist()
    return out


def _build(block: list[tuple[object, np.ndarray]], docs: DataFrame, text: str, size: int) -> _Index:
    """Choose each window's rarest shingle, by occurrences in all documents, as its prefix token.

    A contained window holds all its shingles, so the necessary prefix is one token.
    """
    by_key: dict[tuple[int, bytes], list[object]] = {}
    hashes: dict[tuple[int, bytes], np.ndarray] = {}
    for item, h in block:
        key = (len(h), h.tobytes())
        by_key.setdefault(key, []).append(item)
        hashes[key] = h
    keys = list(by_key)
    flat = _flat([hashes[k] for k in keys])
    width = np.diff(flat.bounds)
    whole = flat.span_hashes(flat.bounds[:-1], flat.bounds[1:])
    sums = _check_sums(flat.hashes)
    check = sums[flat.bounds[1:]] - sums[flat.bounds[:-1]]
    found = {}
    for k in sorted({_shingle(int(x), size) for x in width}):
        first, h = _shingles(flat, k)
        owner = np.searchsorted(flat.bounds, first, "right") - 1
        use = np.minimum(width[owner], size) == k
        found[k] = (owner[use], first[use] - flat.bounds[owner[use]], h[use])
    wanted = {k: np.unique(h) for k, (_, _, h) in found.items()}
    seen = _count_shingles(docs, wanted, text)
    offset = np.zeros(len(keys), np.int64)
    tokens, rows = {}, {}
    for k, (owner, place, h) in found.items():
        rarity = seen[k][np.searchsorted(wanted[k], h)]
        order = np.lexsort((place, rarity, owner))
        best = order[np.concatenate([[True], np.diff(owner[order]) != 0])]
        offset[owner[best]] = place[best]
        by_token = np.argsort(h[best], kind="stable")
        tokens[k], rows[k] = h[best][by_token], owner[best][by_token]
    items = [sorted(set(map(str, by_key[k]))) for k in keys]
    start = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int64)
    return _Index(size, sorted(tokens), tokens, rows, offset, width, whole, check, start, np.array([x for row in items for x in row], object))


def _find(w: Words, index: _Index) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window of the index in the texts of w."""
    firsts, windows = [], []
    owner_end = np.repeat(w.bounds[1:], np.diff(w.bounds))
    owner_start = np.repeat(w.bounds[:-1], np.diff(w.bounds))
    sums = _check_sums(w.hashes)
    for k in index.lengths:
        place, h = _shingles(w, k)
        tokens = index.tokens[k]
        lo, hi = np.searchsorted(tokens, h, "left"), np.searchsorted(tokens, h, "right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            continue
        n = (hi - lo)[hit]
        row = index.rows[k][np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        at = np.repeat(place[hit], n)
        first = at - index.offset[row]
        # positional and length bounds: the window must lie inside its document
        fits = (first >= owner_start[at]) & (first + index.width[row] <= owner_end[at])
        first, row = first[fits], row[fits]
        after = first + index.width[row]
        same = (w.span_hashes(first, after) == index.whole[row]) & (sums[after] - sums[first] == index.check[row])
        firsts.append(first[same])
        windows.append(row[same])
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(firsts), np.concatenate(windows)


def _pass(index_held, last: bool, share: int, schema: pa.Schema):
    """One pass over documents for a block of windows; hits and items gather in two columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_held.value
        for batch in batches:
            hit_bits, item_lists = batch.column(batch.schema.get_field_index("_hit")), batch.column(batch.schema.get_field_index("_items"))
            bits, lists, n_words, n_hit = [], [], [], []
            for i, j, data, offsets in chunks(batch.column(batch.schema.get_field_index("_text"))):
                w = Words(data, offsets, ALNUM_FOLDED)
                total = len(w.hashes)
                first, row = _find(w, index) if index is not None else (np.zeros(0, np.int64),) * 2
                depth = np.zeros(total + 1, np.int64)
                if len(first):
                    np.add.at(depth, first, 1)
                    np.add.at(depth, first + index.width[row], -1)
                hit = np.cumsum(depth[:-1]) > 0
                doc = np.searchsorted(w.bounds, first, "right") - 1
                order = np.argsort(doc, kind="stable")
                cut = np.searchsorted(doc[order], np.arange(j - i + 1))
                for k in range(j - i):
                    own = hit[w.bounds[k] : w.bounds[k + 1]]
                    if old := hit_bits[i + k].as_py():
                        own = own | np.unpackbits(np.frombuffer(old, np.uint8), count=len(own)).astype(bool)
                    found = set(item_lists[i + k].as_py() or ())
                    for x in np.unique(row[order[cut[k] : cut[k + 1]]]) if cut[k] < cut[k + 1] else ():
                        found.update(index.items[index.item_start[x] : index.item_start[x + 1]])
                    bits.append(np.packbits(own).tobytes() if own.any() else None)
                    lists.append(sorted(found) or None)
                    n_words.append(len(own))
                    n_hit.append(int(own.sum()))
            if not last:
                columns = {"_hit": pa.array(bits, pa.binary()), "_items": pa.array(lists, pa.list_(pa.string()))}
            else:
                columns = {
                    "n_words": pa.array(n_words, pa.int64()),
                    "n_hit": pa.array(n_hit, pa.int64()),
                    "n_items": pa.array([len(x or ()) for x in lists], pa.int64()),
                    "items_sha256": pa.array([hashlib.sha256(",".join(x or ()).encode()).hexdigest() for x in lists], pa.string()),
                    "items": pa.array([x or [] for x in lists], pa.list_(pa.string())),
                    "contaminated": pa.array([h > 0 and share * h >= n for h, n in zip(n_hit, n_words, strict=True)], pa.bool_()),
                }
            yield pa.RecordBatch.from_arrays([columns[f] if f in columns else batch.column(batch.schema.get_field_index(f)) for f in schema.names], names=schema.names)

    return run


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    width: int = 13,
    shingle: int = 4,
    share: int = 20,
    text: str = "text",
    item: str = "item_id",
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Adds n_words, n_hit, n_items, items, items_sha256 and contaminated to ``docs``.

    Words are lower-cased (A-Z) runs of letters and digits.  A window is ``width``
    consecutive words of an item, or all words of a shorter item.  Windows are sets
    of ordered shingles of up to ``shingle`` words: the shingle rarest in all
    documents is the prefix a document must hold; its place in the window gives the
    only possible alignment, which must lie inside the document, and all words of
    the window are then compared (two 64-bit hashes of the word sequence).

    Documents are never shuffled.  The benchmark passes through the driver in blocks of
    ``block_windows`` windows, of which it holds two at a time; each is broadcast (about 60
    bytes a window) and is one more map over the documents in the same plan, so executors
    hold the whole benchmark's index: it must be small beside the documents.

    Edge cases: null and empty texts have no words and are clean; items without
    words match nothing; repeated items and rows count each for itself, an item id
    once a document; an empty benchmark leaves all clean; columns of ``docs`` with
    the names of the added ones are replaced.
    """
    spark = docs.sparkSession
    added = ("n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated")
    base, columns = boxed(docs, {"_text": text}, added)
    out = base.withColumns({"_hit": F.lit(None).cast("binary"), "_items": F.lit(None).cast("array<string>")})

    def blocks() -> Iterator[list[tuple[object, np.ndarray]]]:
        block: list[tuple[object, np.ndarray]] = []
        for name, value in benchmark.select(item, text).toLocalIterator(prefetchPartitions=False):
            for _, h in _windows(pa.array([value], pa.string()), width):
                if len(block) >= block_windows:
                    yield block
                    block = []
                block.append((name, h))
        yield block

    passes = blocks()
    block = next(passes)
    last = False
    while not last:
        index = _build(block, base, "_text", shingle) if block else None
        block = next(passes, None)
        last = block is None
        schema = f"box {base.schema['box'].dataType.simpleString()}, _text string, "
        schema += "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean" if last else "_hit binary, _items array<string>"
        order = ["box", "_text", *(added if last else ["_hit", "_items"])]
        out = out.mapInArrow(trimmed(_pass(spark.sparkContext.broadcast(index), last, share, pa.schema([(n, pa.null()) for n in order]))), schema)
    return out.select(*columns, *added)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
