"""Line dedup: lines that many documents share stay in one of them, by a sharded minimal perfect hash of the lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import boxed, kept, release, table
from .words import _BYTE_VALUES, CHUNK_BYTES, _run_hashes, chunks, mix, trimmed

U64 = np.uint64
#: Distinct lines that a shard of the index holds, about.
SHARD_LINES = 1 << 17
#: (document, line) pairs that probe a shard in one task, about.
PROBE_ROWS = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FIRST = _BYTE_VALUES.copy()
_SECOND = mix(_BYTE_VALUES + U64(0x9E3779B97F4A7C15))
for _values in (_FIRST, _SECOND):
    _values[65:91] = _values[97:123]


# ---- lines of texts


def _ranks(marks: np.ndarray) -> np.ndarray:
    out = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=out[1:])
    return out


class Lines:
    """The lines of a few texts: starts and ends (in bytes, the newline left out), bounds (text i has lines bounds[i]:bounds[i + 1]),
    and for the lines whose key has at least ``least`` code points their numbers (``long``) and two 64-bit names of the key."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int):
        feeds = np.flatnonzero(data == 10)
        n = len(offsets) - 1
        inner = np.searchsorted(feeds, offsets)  # newlines before each text
        self.bounds = inner + np.arange(n + 1)
        self.starts, self.ends = np.empty(self.bounds[-1], np.int64), np.empty(self.bounds[-1], np.int64)
        self.starts[self.bounds[:-1]], self.ends[self.bounds[1:] - 1] = offsets[:-1], offsets[1:]
        at = np.arange(len(feeds)) + np.searchsorted(offsets[1:], feeds, "right")
        self.ends[at], self.starts[at + 1] = feeds, feeds + 1
        inked = np.flatnonzero(~_SPACE[data])
        first, after = np.searchsorted(inked, self.starts), np.searchsorted(inked, self.ends)
        some = np.flatnonzero(after > first)
        a, b = inked[first[some]], inked[after[some] - 1] + 1
        points = _ranks((data & 0xC0) != 0x80)  # a code point begins at every byte but those that continue one
        enough = points[b] - points[a] >= least
        self.long, a, b = some[enough], a[enough], b[enough]
        self.names = np.empty((2, len(a)), U64)
        k = 0
        while k < len(a):  # a block of lines at a time, so that a long text takes little more memory than its bytes
            z = max(k + 1, int(np.searchsorted(b, a[k] + CHUNK_BYTES, "right")))
            for row, values in enumerate((_FIRST, _SECOND)):
                self.names[row, k:z] = _run_hashes(data, a[k:z], b[k:z], values)
            k = z

    def of_long(self) -> np.ndarray:
        """The text of each line of ``long``."""
        return np.searchsorted(self.bounds, self.long, "right") - 1


def _pairs(least: int):
    """Arrow batches of (text) with other columns before it -> these columns and the two names of each distinct long line of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for i, _, data, offsets in chunks(batch.column(last)):
                lines = Lines(data, offsets, least)
                text = lines.of_long()
                order = np.lexsort((lines.names[1], lines.names[0], text))
                text, names = text[order], lines.names[:, order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (names[:, 1:] != names[:, :-1]).any(0)
                rows = pa.array(text[new] + i)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(rows) for k in range(last)), *(pa.array(x[new].view(np.int64)) for x in names)],
                    names=[*(f"c{k}" for k in range(last)), "name", "check"],
                )

    return trimmed(run)


# ---- minimal perfect hash


class PerfectHash:
    """n distinct pairs of 64-bit names -> 0 .. n - 1, each once.

    Level after level, the keys that are left hash into two bits a key; a key alone at its
    bit has found its place, the others go on.  A key's number is the count of set bits
    before its own over all levels.  About four bits a key; no key is stored.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.words, self.sizes = words, sizes
        self.before = _ranks(np.bitwise_count(words))
        self.at = np.concatenate([[0], np.cumsum(sizes)])  # first word of each level

    @staticmethod
    def _bit(name: np.ndarray, check: np.ndarray, level: int, words: int) -> np.ndarray:
        h = mix(name + U64((level * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))) ^ check
        return (mix(h) % U64(words * 64)).astype(np.int64)

    @classmethod
    def of(cls, name: np.ndarray, check: np.ndarray) -> PerfectHash:
        words, sizes, level = [], [], 0
        while len(name):
            size = -(-2 * len(name) // 64)
            bit = cls._bit(name, check, level, size)
            hits = np.bincount(bit, minlength=size * 64)
            words.append(np.packbits(hits == 1, bitorder="little").view(U64))
            sizes.append(size)
            rest = hits[bit] > 1
            name, check, level = name[rest], check[rest], level + 1
        return cls(np.concatenate(words) if words else np.zeros(0, U64), np.array(sizes, np.int64))

    def find(self, name: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The number of each key; of a pair that is no key any number, or -1."""
        out = np.full(len(name), -1, np.int64)
        left = np.arange(len(name))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            bit = self._bit(name[left], check[left], level, int(size))
            word, low = self.at[level] + (bit >> 6), (bit & 63).astype(U64)
            found = (self.words[word] >> low) & U64(1) == 1
            below = np.bitwise_count(self.words[word] & ((U64(1) << low) - U64(1)))
            out[left[found]] = (self.before[word] + below)[found]
            left = left[~found]
        return out


_INDEX = "shard long, words binary, sizes binary, prints binary, counts binary, holders binary, null_holders binary"


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    name, check = (rows[c].to_numpy(np.int64).view(U64) for c in ("name", "check"))
    whole = PerfectHash.of(name, check)
    at = whole.find(name, check)
    prints, counts, holders, empty = np.empty(len(at), U64), np.empty(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    prints[at], counts[at], empty[at] = mix(check ^ name), rows["n"].to_numpy(), rows["holder"].isna().to_numpy()
    holders[at] = rows["holder"].fillna(0).to_numpy(np.int64)
    arrays = (whole.words, whole.sizes, prints, counts, holders, empty)
    return pd.DataFrame([[int(rows["shard"].iloc[0]), *(x.tobytes() for x in arrays)]], columns=[c.split()[0] for c in _INDEX.split(", ")])


def line_index(pairs: DataFrame, *, shard_lines: int = SHARD_LINES) -> DataFrame:
    """A table with a row for each shard of the distinct lines of ``pairs`` (doc, name, check; doc is a long or null).

    A shard holds the bits of a minimal perfect hash of its lines and, by its numbers, arrays:
    a fingerprint of the line (64 bits), the number of documents that hold it, and the largest
    of these.  Shards are ranges of the hash; there are as many as distinct lines ask for.
    Null ids are one document, below all others.
    """
    lines = kept(pairs.groupBy("name", "check").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("holder"), F.bool_or(F.isnull("doc")).cast("long").alias("null_doc")))
    shards = max(1, lines.count() // shard_lines)
    rows = lines.select(F.pmod("name", F.lit(shards)).alias("shard"), "name", "check", (F.col("n") + F.col("null_doc")).alias("n"), "holder")
    out = kept(rows.groupBy("shard").applyInPandas(_build, _INDEX))
    release(lines)
    return out


def _probe(least: int):
    """(shard, share), probes and index -> the probes whose line at least ``least`` documents hold, their own not being the largest."""

    def run(probes: pa.Table, index: pa.Table) -> pa.Table:
        row = {c: index.column(c)[0].as_py() for c in index.column_names}
        whole = PerfectHash(np.frombuffer(row["words"], U64), np.frombuffer(row["sizes"], np.int64))
        prints, counts, holders, empty = (np.frombuffer(row[c], t) for c, t in (("prints", U64), ("counts", np.int64), ("holders", np.int64), ("null_holders", bool)))
        name, check = (probes.column(c).to_numpy().view(U64) for c in ("name", "check"))
        at = whole.find(name, check)
        doc = probes.column("doc").combine_chunks()
        null, doc = np.asarray(doc.is_null()), np.asarray(doc.fill_null(0))
        known = (at >= 0) & (prints[at] == mix(check ^ name))
        largest = np.where(null, empty[at], ~empty[at] & (doc == holders[at]))
        out = probes.filter(pa.array(known & (counts[at] >= least) & ~largest))
        return out.select(["doc", "text_name", "name", "check"])

    return run


def repeats(pairs: DataFrame, index: DataFrame, *, documents: int = 5, probe_rows: int = PROBE_ROWS) -> DataFrame:
    """The rows of ``pairs`` (doc, text_name, name, check) whose line at least ``documents`` documents of ``index`` hold, the largest not being doc.

    Pairs go to their line's shard and look their line up in its arrays.  A shard's pairs are
    dealt in shares of about ``probe_rows``, each with a copy of the shard, so a line that a
    third of all documents hold is looked up by many tasks.
    """
    shards = index.select("shard")
    n = shards.count()
    placed = pairs.withColumn("shard", F.pmod("name", F.lit(max(1, n))))
    share = placed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / probe_rows).alias("shares"))
    probes = placed.join(share, "shard").withColumn("share", F.pmod(F.xxhash64("doc", "text_name"), "shares"))
    copies = index.join(share, "shard").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    schema = "doc long, text_name long, name long, check long"
    return probes.drop("shares").groupBy("shard", "share").cogroup(copies.drop("shares").groupBy("shard", "share")).applyInArrow(_probe(documents), schema)


def _among(rows: tuple[np.ndarray, ...], wanted: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether each row is one of the wanted rows."""
    whole = [np.concatenate(x) for x in zip(rows, wanted, strict=True)]
    order = np.lexsort(whole[::-1])
    if not len(order):
        return np.zeros(0, bool)
    same = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in whole])
    group = np.concatenate([[0], np.cumsum(~same)])
    found, out = np.zeros(len(order), bool), np.empty(len(order), bool)
    found[group[order >= len(rows[0])]] = True
    out[order] = found[group]
    return out[: len(rows[0])]


def _drop(least: int):
    """Arrow batches of (box, text, names of lines to drop, their checks) -> box, text, n_lines, n_dropped, kept."""

    def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, data, offsets in chunks(batch.column(1)):
            lines = Lines(data, offsets, least)
            lists = [batch.column(k).slice(i, j - i) for k in (2, 3)]
            owner = np.repeat(np.arange(j - i), np.asarray(lists[0].value_lengths()))
            gone = np.zeros(lines.bounds[-1], bool)
            gone[lines.long] = _among((lines.of_long(), *lines.names), (owner, *(np.asarray(x.flatten()).view(U64) for x in lists)))
            stay = np.flatnonzero(~gone)
            part = np.searchsorted(stay, lines.bounds)
            texts = [b"\n".join(data[lines.starts[x] : lines.ends[x]].tobytes() for x in stay[part[k] : part[k + 1]]) for k in range(j - i)]
            n = np.diff(lines.bounds)
            yield out(batch, i, j, n, n - np.diff(part), pa.array(texts, pa.binary()).cast(pa.string()))

    def out(batch: pa.RecordBatch, i: int, j: int, n_lines: np.ndarray, n_dropped: np.ndarray, kept_text: pa.Array) -> pa.RecordBatch:
        as_given = (batch.column(k).slice(i, j - i) for k in (0, 1))
        return pa.RecordBatch.from_arrays([*as_given, pa.array(n_lines), pa.array(n_dropped), kept_text], names=["box", "_text", "n_lines", "n_dropped", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = pc.greater(pc.fill_null(pc.list_value_length(batch.column(2)), 0), 0)
            yield from pieces(batch.filter(some))
            rest = batch.filter(pc.invert(some))  # nothing to drop: the texts as they are
            for i, j, data, offsets in chunks(rest.column(1)):
                n = np.diff(np.searchsorted(np.flatnonzero(data == 10), offsets)) + 1
                yield out(rest, i, j, n, np.zeros(j - i, np.int64), rest.column(1).slice(i, j - i).fill_null(""))

    return trimmed(run)


def dedup(
    docs: DataFrame, *, points: int = 40, documents: int = 5, id: str = "doc_id", text: str = "text", shard_lines: int = SHARD_LINES, probe_rows: int = PROBE_ROWS
) -> DataFrame:
    """Adds n_lines, n_dropped and kept to ``docs``: the text without the lines that many documents share.

    A line's key is the line without white space at its ends and with A-Z in lower case.
    Lines whose key has at least ``points`` code points and stands in at least ``documents``
    documents go from all documents but that of the largest id; the other lines stay, joined
    by newlines.  A key is known by 128 bits of hash.

    Texts are read once for the names of their long lines, each once a document; an index of
    minimal perfect hashes (line_index) takes them in, the same pairs look themselves up in it
    (repeats), and what is to go meets the texts by id and a hash of the text.  Lines
    themselves are never shuffled, nor a line's documents gathered anywhere.

    Edge cases: a null or empty text is one empty line; rows of one id are one document, and
    all of them keep or lose a line; null ids are one document below all others; an empty
    table gives an empty one; columns of ``docs`` with the names of the added ones are replaced.
    """
    added = ("n_lines", "n_dropped", "kept")
    base, columns = boxed(docs, {"_doc": F.col(f"`{id}`").cast("long"), "_text": text, "_name": F.xxhash64(F.col(f"`{text}`"))}, added)
    seen = base.select("_doc", "_name", "_text").mapInArrow(_pairs(points), "doc long, text_name long, name long, check long")
    pairs = kept(seen.distinct())
    index = line_index(pairs.select("doc", "name", "check"), shard_lines=shard_lines)
    found = repeats(pairs, index, documents=documents, probe_rows=probe_rows)
    gone = kept(found.groupBy("doc", "text_name").agg(F.collect_list(F.struct("name", "check")).alias("gone")))
    release(pairs, index)
    both = base.join(gone, F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_name") == F.col("text_name")), "left")
    none = F.array().cast("array<bigint>")
    both = both.select("box", "_text", F.coalesce("gone.name", none).alias("names"), F.coalesce("gone.check", none).alias("checks"))
    schema = f"box {base.schema['box'].dataType.simpleString()}, _text string, n_lines long, n_dropped long, kept string"
    return both.mapInArrow(_drop(points), schema).select(*columns, *added)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
