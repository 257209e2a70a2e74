"""Document fingerprints: digests of improbable features in chained Bloom filters."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import _BYTE_POWERS, _BYTE_VALUES, U64, chunks, mix, trimmed

#: Bytes of a window; offsets of which one is a start where words give none.
WINDOW, STEP = 32, 8
#: Windows of a text for each further window of its neighbourhoods, and the windows of the widest.
GROWTH, NEAR = 16, 24
#: Bits of a filter, bits a feature sets, and features a filter takes.
BITS, HASHES, FULL = 2048, 5, 160
#: Classes of entropy.
RANKS = 1024
#: Standard deviations of chance overlap that count as nothing.
NOISE = 4.0
_ROWS_A_PART, _PARTS = 8192, 1 << 16
_BLOCK = 1 << 16

# 32 classes of bytes: letters, white space, digits, signs and three of the rest
_CLASS = np.array([29 + b % 3 for b in range(256)], np.int64)
_CLASS[33:127] = 28
_CLASS[:33] = 26
_CLASS[48:58] = 27
_CLASS[65:91] = np.arange(26)
_CLASS[97:123] = np.arange(26)
_PLOGP = np.array([0.0] + [c / WINDOW * np.log2(WINDOW / c) for c in range(1, WINDOW + 1)], np.float32)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def _far(data: np.ndarray, start: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Content-defined offsets where the next start, or the text's end, is more than WINDOW bytes off.

    Each STEP offsets in a row between two such starts give the one with the least hash of
    STEP bytes, so no byte of a long run is further than STEP from an offset.
    """
    wide = np.flatnonzero(after - start > WINDOW)
    if not len(wide):
        return np.zeros(0, np.int64)
    size = after[wide] - start[wide] - 1
    place = _spread(start[wide] + 1, size)  # only bytes of such runs are hashed
    n = len(place)
    up, down = _BYTE_POWERS.get(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE_VALUES[data[place]] * up[:n], out=sums[1:])
    best = mix((sums[STEP:] - sums[:-STEP]) * down[: n - STEP + 1]) >> U64(32) << U64(32) | np.arange(n - STEP + 1, dtype=U64)
    span = 1
    while span < STEP:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    inside = _spread(np.cumsum(size) - size, size - 2 * STEP + 2)  # hashes that reach beyond the run are left out
    return place[np.unique(best[inside] & U64(0xFFFFFFFF)).astype(np.int64)]


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, text, entropy class) of each window: WINDOW bytes from a word's first byte on.

    Runs of more than WINDOW bytes without such a start have content-defined ones, and each
    text's last WINDOW bytes are a window, so windows cover all bytes.  A text of less than
    WINDOW bytes is one window as a whole.
    """
    n = len(data)
    word = data > 32
    first = np.zeros(n, bool)
    first[1:] = word[1:] & ~word[:-1]
    head = offsets[:-1][np.diff(offsets) > 0]
    first[head] = True
    start = np.flatnonzero(first)
    text = np.searchsorted(offsets, start, "right") - 1
    after = np.minimum(np.append(start[1:], n), offsets[text + 1])
    last = offsets[1:][np.diff(offsets) >= WINDOW] - WINDOW
    first[_far(data, start, after)] = True
    first[last] = True
    start = np.flatnonzero(first)
    text = np.searchsorted(offsets, start, "right") - 1
    fits = (start + WINDOW <= offsets[text + 1]) | (start == offsets[text])
    start, text = start[fits], text[fits]
    if not len(start):
        return start, text, start
    size = np.minimum(offsets[text + 1] - start, WINDOW)
    seen = np.lib.stride_tricks.sliding_window_view(np.concatenate([_CLASS[data], np.full(WINDOW, 32)]), WINDOW)
    entropy = np.empty(len(start), np.float32)
    for k in range(0, len(start), _BLOCK):
        classes = np.where(np.arange(WINDOW) < size[k : k + _BLOCK, None], seen[start[k : k + _BLOCK]], 32)
        at = (classes + np.arange(len(classes))[:, None] * 33).ravel()
        entropy[k : k + _BLOCK] = _PLOGP[np.bincount(at, minlength=33 * len(classes)).reshape(-1, 33)[:, :32]].sum(axis=1)
    return start, text, np.minimum((entropy * (RANKS / 5.0)).astype(np.int64), RANKS - 1)


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(RANKS, np.int64)
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column(0), 1 << 18):
            total += np.bincount(windows(data, offsets)[2], minlength=RANKS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["rank", "n"])


def precedence(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Place of each entropy class, rarest in all documents first; RANKS rows at most reach the driver."""
    rows = docs.select(text).mapInArrow(trimmed(_histogram), "rank int, n long").groupBy("rank").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(RANKS, np.int64)
    for r in rows:
        count[r["rank"]] = r["n"]
    place = np.empty(RANKS, np.int64)
    place[np.lexsort((np.arange(RANKS), count))] = np.arange(RANKS)
    return place


def digests(texts: list[bytes], place: np.ndarray) -> list[np.ndarray]:
    """Chained filters of each text, as rows of BITS / 8 bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    start, text, entropy = windows(data, offsets)
    empty = np.zeros((0, BITS // 8), np.uint8)
    if not len(start):
        return [empty] * len(texts)
    # a window leads a neighbourhood if its entropy class is the rarest there, leftmost first
    key = place[entropy] * len(start) + np.arange(len(start))
    count = np.bincount(text, minlength=len(texts))
    lead = np.ones(len(start), np.int64)  # windows of the widest neighbourhood of its text that it leads
    left, right = np.ones(len(start), bool), np.ones(len(start), bool)
    for d in range(1, min(NEAR, len(start))):
        same = text[d:] == text[:-d]
        left[:d], right[-d:] = False, False
        left[d:] &= same & (key[:-d] > key[d:])
        right[:-d] &= same & (key[d:] > key[:-d])
        lead += left
        lead += right
    chosen = lead >= np.minimum(1 + count // GROWTH, NEAR)[text]
    start, text = start[chosen], text[chosen]
    end = np.minimum(start + WINDOW, offsets[text + 1])
    up, down = _BYTE_POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))
    order = np.lexsort((start, h, text))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    keep = np.sort(order[new])
    text, h = text[keep], h[keep]
    count = np.bincount(text, minlength=len(texts))
    filters = -(-count // FULL)
    base = np.concatenate([[0], np.cumsum(filters)])
    nth = np.arange(len(text)) - np.concatenate([[0], np.cumsum(count)[:-1]])[text]
    row = base[text] + nth // FULL
    bits = np.zeros((base[-1], BITS), bool)
    for k in range(HASHES):
        bits[row, ((h >> U64(11 * k)) & U64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[base[i] : base[i + 1]] for i in range(len(texts))]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: each filter of the shorter digest with its best partner; overlap of bits between what chance explains and full."""
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    if not len(a):
        return float(len(b) == 0)
    if a.shape == b.shape and (a == b).all():
        return 1.0
    x, y = (np.unpackbits(m, axis=1).astype(np.float32) for m in (a, b))
    shared = x @ y.T
    n, m = x.sum(1)[:, None], y.sum(1)[None, :]
    most, chance = np.minimum(n, m), n * m / BITS
    floor = chance + NOISE * np.sqrt(chance * (1 - n / BITS) * (1 - m / BITS))
    return float(np.clip((shared - floor) / np.maximum(most - floor, 1e-9), 0, 1).max(axis=1).mean())


def fingerprint(digest: np.ndarray) -> str:
    return f"{len(digest)}:{base64.b64encode(digest.tobytes()).decode()}"


def parse(value: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(value.partition(":")[2]), np.uint8).reshape(-1, BITS // 8)


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, text: str, id: str) -> DataFrame:
    """Rows (part, guest, doc_id, text) dealt by ranges of ids, each part followed by the next part's first row as a guest.

    Only bounds and least ids of the parts reach the driver: at most _PARTS numbers.
    """
    low = -(1 << 63)
    base = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("_o", F.coalesce("doc_id", F.lit(low)))
    total = docs.select(F.count(F.lit(1))).collect()[0][0]
    parts = max(1, min(_PARTS, total // _ROWS_A_PART))
    cuts: list[int] = []
    if parts > 1:
        points = base.select(F.percentile_approx("_o", [k / parts for k in range(1, parts)], max(10_000, 4 * parts)).alias("p")).collect()[0][0]
        cuts = sorted(set(points or []))
    own = F.lit(0)

    @F.pandas_udf("int")
    def part(o: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts, np.int64), o.to_numpy(np.int64), "right").astype(np.int32))

    if cuts:
        own = part("_o")
    least = sorted((r["part"], r["o"]) for r in base.select("_o", own.alias("part")).groupBy("part").agg(F.min("_o").alias("o")).collect())
    firsts = {o: least[k - 1][0] for k, (_, o) in enumerate(least)}  # the first part's guests go to the last

    @F.pandas_udf("int")
    def host(o: pd.Series) -> pd.Series:
        return o.map(firsts).astype("Int32")

    dealt = base.withColumns({"part": own, "_host": host("_o")})
    places = F.filter(F.array(F.struct(F.col("part"), F.lit(False).alias("guest")), F.struct(F.col("_host").alias("part"), F.lit(True).alias("guest"))), lambda x: x["part"].isNotNull())
    rows = dealt.withColumn("x", F.explode(places)).select("x.part", "x.guest", "doc_id", "_o", "text")
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "guest", "_o", "text").drop("_o")


def _values(column: pa.Array) -> Iterator[object]:
    return (x.as_py() for x in column)


def _compare(place_held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = place_held.value

        def work(rows: list[tuple[int | None, str]], following: str) -> pa.RecordBatch:
            texts = [t for _, t in rows] + [following]
            changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
            found = digests([t.encode() for t in texts + changed], place)
            n = len(rows)
            own, new = found[: n + 1], found[n + 1 :]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([d for d, _ in rows], pa.int64()), pa.array([len(t) for _, t in rows], pa.int64()), pa.array(changed, pa.string()),
                    pa.array([fingerprint(x) for x in own[:n]]), pa.array([fingerprint(x) for x in new]),
                    pa.array([likeness(own[k], new[k]) for k in range(n)], pa.float64()), pa.array([likeness(own[k], own[k + 1]) for k in range(n)], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        rows: list[tuple[int | None, str]] = []
        part, size, done = None, 0, False
        for batch in batches:
            for p, guest, doc, text in zip(*(_values(batch.column(k)) for k in range(4)), strict=True):  # one text at a time
                if guest:
                    if not done and rows:
                        yield work(rows, text)
                        rows, size, done = [], 0, True
                    continue
                if p != part:
                    part, done = p, False
                if size > 1 << 18:
                    yield work(rows, text)
                    rows, size = [], 0
                rows.append((doc, text))
                size += len(text) + 64

    return run


def fingerprints(docs: DataFrame, *, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    Windows of WINDOW bytes at the beginnings of words, and at content-defined offsets in
    runs without any, are ranked by how rare their entropy is in all documents; a window
    that is the rarest of a neighbourhood is a feature.  Neighbourhoods grow with the text,
    by a window for each GROWTH windows, up to NEAR windows; what leads a wide one leads a
    narrow one too, so a longer text's features are among those that its part would have.
    Features go, HASHES bits each, into filters of BITS bits, FULL a filter, a new one
    chained on when one is full.  Likeness compares bit overlap, normalised between NOISE
    standard deviations above chance and full.

    Texts travel once, to parts that are ranges of ids of about equal count; a part
    is read in order and holds a quarter of a megabyte of text at a time.  Edge cases:
    null is empty; an empty text has no filter, likeness 1 with another and 0 with
    the rest; a text shorter than a window is one feature; null ids come first; equal
    ids come in the order of their texts; the only row follows itself; an empty table gives
    an empty one; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(precedence(docs, text))
    return with_next(docs, text, id).mapInArrow(
        trimmed(_compare(held)), "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fingerprints(docs).select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", F.round("near_edited", 6).alias("near_edited"), F.round("near_next", 6).alias("near_next")
    )
