"""Cross-entropy difference of two word n-gram models over one vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import boxed, kept
from .words import ALNUM_FOLDED, U64, Words, chunks, give_back, trimmed

#: Words of the longest gram.
ORDER = 2
#: Weight of the next shorter gram's estimate, in counts.
PSEUDO = 8.0
#: Bytes of text whose grams are counted, sent and scored together.
_CHUNK = 1 << 23
#: Bytes of text for each bucket of grams, so that a bucket holds about as many grams at every size.
_BUCKET = 1 << 22


@dataclass
class Grams:
    """The grams of some texts. sets: by length, in order; at: place of each word's gram in its set, -1 where the text has too few words before it."""

    sets: list[np.ndarray]
    at: list[np.ndarray]
    bounds: np.ndarray

    def counts(self, size: int, use: np.ndarray | None = None) -> np.ndarray:
        at = self.at[size]
        return np.bincount(at[(at >= 0) if use is None else (at >= 0) & use], minlength=len(self.sets[size]))


def grams(texts: pa.Array, order: int) -> Grams:
    """Grams of up to ``order`` words, as 64-bit hashes; a text's first words have no longer ones."""
    found: list[list[np.ndarray]] = [[] for _ in range(order)]
    places: list[list[np.ndarray]] = [[] for _ in range(order)]
    bounds, total = [np.zeros(1, np.int64)], 0
    for _, _, data, offsets in chunks(texts):
        w = Words(data, offsets, ALNUM_FOLDED)
        for k in range(order):
            first, h = w.windows(k + 1) if k else (np.arange(len(w.hashes)), w.hashes)
            found[k].append(h)
            places[k].append(total + first + k)
        bounds.append(total + w.bounds[1:])
        total += len(w.hashes)
    out = Grams([], [], np.concatenate(bounds))
    for h, place in zip(found, places, strict=True):
        own, back = np.unique(np.concatenate(h) if h else np.zeros(0, U64), return_inverse=True)
        at = np.full(total, -1)
        at[np.concatenate(place) if place else []] = back
        out.sets.append(own)
        out.at.append(at)
    return out


def losses(found: Grams, counts: list[np.ndarray], words: int, tokens: int, share: float) -> np.ndarray:
    """Bits of loss of each word under a model; a gram's estimate leans on the next shorter one's.

    counts: by length, of the grams of ``found.sets``; words: of the vocabulary;
    tokens: of all texts of the model; counts and tokens are multiplied by ``share``.
    """
    before = counts[0][found.at[0]] * share
    p = (before + PSEUDO / max(words, 1)) / (tokens * share + PSEUDO)
    for k in range(1, len(found.sets)):
        whole = found.at[k] >= 0
        own = np.zeros(len(p))
        own[whole] = counts[k][found.at[k][whole]] * share
        context = np.zeros(len(p))
        context[1:] = before[:-1]  # of the gram that ended at the word before
        context[~whole] = 0
        p = (own + PSEUDO * p) / (context + PSEUDO)
        before = own
    return -np.log2(p)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the text's bytes, and numbers runs of rows of about _CHUNK bytes; the text is the second column."""
    chunk, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = (size + np.cumsum(lengths) - lengths) // _CHUNK
        size += int(lengths.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunk + at), pa.array(lengths)], names=[*batch.schema.names, "chunk", "bytes"])


def _blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices of an array as binary values."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    """Binary values as one array."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if data is not None and data.size else np.zeros(0, kind)


def _asked(order: int, bits: int):
    """Rows (chunk, size, bucket, grams, n0, n1) of (text, chunk, target): the grams of each chunk and how often all its texts and its target texts have them."""

    def rows(chunk: int, texts: list[pa.Array], marks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = grams(pa.concat_arrays(texts), order)
        use = np.repeat(np.concatenate(marks), np.diff(found.bounds))
        edges = (np.arange(1, 1 << bits, dtype=U64) << U64(64 - bits)) if bits else np.zeros(0, U64)
        for k, own in enumerate(found.sets):
            cut = np.concatenate([[0], np.searchsorted(own, edges), [len(own)]])
            full = np.flatnonzero(np.diff(cut))
            bounds = np.append(cut[full], len(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(full), chunk)), pa.array(np.full(len(full), k, np.int8)), pa.array(full.astype(np.int64)), _blobs(own, bounds), _blobs(found.counts(k).astype("<u4"), bounds), _blobs(found.counts(k, use).astype("<u4"), bounds)],
                names=["chunk", "size", "bucket", "grams", "n0", "n1"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, marks = None, [], []
        for batch in batches:
            chunk = batch.column(1).to_numpy()
            target = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero(np.diff(chunk)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(chunk)], strict=True):
                if a == b:
                    continue
                if chunk[a] != now and texts:
                    yield from rows(now, texts, marks)
                    texts, marks = [], []
                now = int(chunk[a])
                texts.append(batch.column(0).slice(a, b - a))
                marks.append(target[a:b])
        if texts:
            yield from rows(now, texts, marks)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers (chunk, size, bucket, n0, n1, words, all0, all1) to rows sorted by bucket: counts of all chunks, in the places of the asked grams."""

    def answers(rows: pa.Table) -> pa.RecordBatch:
        column = {n: rows[n].combine_chunks() for n in rows.column_names}
        column = {n: pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x for n, x in column.items()}
        gram, n = _flat(column["grams"], "<u8"), [_flat(column[c], "<u4").astype(np.float64) for c in ("n0", "n1")]
        lengths = pc.binary_length(column["grams"]).to_numpy() // 8
        size = column["size"].to_numpy()
        of = np.repeat(size, lengths)
        total = [np.zeros(len(gram)), np.zeros(len(gram))]
        seen = np.zeros((3, len(size)), np.int64)
        for k in np.unique(size):
            at = np.flatnonzero(of == k)
            own, back = np.unique(gram[at], return_inverse=True)
            for m in range(2):
                total[m][at] = np.bincount(back, weights=n[m][at])[back]
            if k == 0:
                seen[:, 0] = len(own), n[0][at].sum(), n[1][at].sum()
        kind = "<u4" if not len(gram) or total[0].max() < 1 << 32 else "<u8"
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        return pa.RecordBatch.from_arrays(
            [column["chunk"], column["size"], column["bucket"], *(_blobs(x.astype(kind), bounds) for x in total), *(pa.array(x) for x in seen)],
            names=["chunk", "size", "bucket", "n0", "n1", "words", "all0", "all1"],
        )

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        bucket = batch["bucket"].to_numpy()
        if bucket[-1] == held[0]["bucket"][0].as_py():
            continue
        rows = pa.Table.from_batches(held)
        cut = rows.num_rows - len(bucket) + int(np.searchsorted(bucket, bucket[-1]))
        yield answers(rows.slice(0, cut))
        held = rows.slice(cut).to_batches()
    if held:
        yield answers(pa.Table.from_batches(held))


def score(docs: DataFrame, target: DataFrame, *, order: int = ORDER, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Adds n_tokens, target_loss, background_loss and score (their difference; lower: more like the target), bits a word.

    Words are lower-cased runs of letters and digits.  The background model counts the grams
    of up to ``order`` words of all documents, the target model those of the documents whose id is
    in ``target``.  Both have all words of all documents as vocabulary and the same smoothing; the
    background's counts are scaled to the target's number of words.

    Texts travel to their marks by id, and are then kept in chunks of about _CHUNK bytes.  A chunk
    sends each of its grams once, packed by bucket (a range of hashes); a bucket sums them over all
    chunks and answers in the same places; a chunk meets its answers and scores its
    texts.  So both models hold every gram of the corpus and no task holds a model: there is
    a bucket for each _BUCKET bytes of text, and a gram that all texts share is one entry a
    chunk.  One row of totals reaches the driver.

    Edge cases: null and empty texts have no word, losses of 0 and a score of 0; a text's first
    word is estimated by itself; without target rows the target's losses are those of no
    counts; repeated rows score alike and count each, an id in ``target`` counts once; null ids
    are background; an empty table gives an empty one; columns of ``docs`` with the added names
    are replaced.
    """
    added = ("n_tokens", "target_loss", "background_loss", "score")
    rows, columns = boxed(docs, {"text": text, "id": F.col(id)}, added)
    marks = target.select(F.col(id).alias("id"), F.lit(True).alias("target")).dropna().distinct()
    joined = rows.join(marks.hint("merge"), "id", "left").select("box", "text", "target")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields)
    held = kept(joined.mapInArrow(_chunked, fields + ", chunk long, bytes long"))
    bits = max(4, ((held.agg(F.sum("bytes")).collect()[0][0] or 0) // _BUCKET).bit_length())
    answers = kept(
        held.select("text", "chunk", "target")
        .mapInArrow(trimmed(_asked(order, bits)), "chunk long, size byte, bucket long, grams binary, n0 binary, n1 binary")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(trimmed(_summed), "chunk long, size byte, bucket long, n0 binary, n1 binary, words long, all0 long, all1 long")
    )
    words, *tokens = (x or 0 for x in answers.agg(F.sum("words"), F.sum("all0"), F.sum("all1")).collect()[0])
    share = (min(1.0, tokens[1] / tokens[0]) if tokens[0] and tokens[1] else 1.0, 1.0)

    def work(own: pa.Table, got: pa.Table) -> pa.Table:
        texts = own["text"].combine_chunks()
        found = grams(texts, order)
        got = got.sort_by([("size", "ascending"), ("bucket", "ascending")]).combine_chunks()
        size = got["size"].to_numpy()
        n = np.diff(found.bounds)
        mean = []
        for m in (1, 0):
            counts = []
            for k in range(order):
                values = got[f"n{m}"].filter(pa.array(size == k)).to_pylist()
                length = max(len(found.sets[k]), 1)
                counts.append(np.frombuffer(b"".join(values), f"<u{sum(map(len, values)) // length or 4}").astype(np.float64))
            loss = np.concatenate([[0.0], np.cumsum(losses(found, counts, words, tokens[m], share[m]))])
            mean.append((loss[found.bounds[1:]] - loss[found.bounds[:-1]]) / np.maximum(n, 1))
        made = [pa.array(n.astype(np.int64)), *(pa.array(np.round(x, 6)) for x in (mean[0], mean[1], mean[0] - mean[1]))]
        give_back()
        return pa.Table.from_arrays([own["box"], own["text"], *made], names=["box", "text", *added])

    scored = (
        held.select("box", "text", "chunk").groupBy("chunk").cogroup(answers.select("chunk", "size", "bucket", "n0", "n1").groupBy("chunk"))
        .applyInArrow(work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.select("box", "text").schema.fields) + ", n_tokens long, target_loss double, background_loss double, score double")
    )
    return scored.select(*columns, *added)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled of quality and not toxic; background: all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND toxic = 0").select("doc_id")
    return score(docs, target).drop("text")
