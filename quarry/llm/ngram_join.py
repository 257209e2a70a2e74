"""N-gram Jaccard join: a distributed prefix-tree join over sets of word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import components, kept, release
from .words import SPACED_FOLDED, U64, Words, chunks, mix, trimmed

#: Counters of the sketch that orders shingles by rarity (one byte each once broadcast).
SKETCH = 1 << 18
#: Rows of a bucket up to which all its pairs are candidates; beyond, a chain and pivots, then blocks.
SMALL_BUCKET = 32
#: Rows of a block of a large bucket, and of one tree.
BLOCK, TREE = 512, 256
_BITS = 1024
#: Names of sets that a task remembers, to give a set's prefix once; one that is forgotten is given again.
_RECENT = 1 << 16


def _need(a, b, percent: int):
    """Least intersection of sets of a and b with 100 * intersection >= percent * union."""
    return -((-percent * (a + b)) // (100 + percent))


def _sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, bounds): each text's distinct shingles in ascending order."""
    w = Words(data, offsets, SPACED_FOLDED)
    texts = len(offsets) - 1
    first, h = w.windows(n)
    doc = np.searchsorted(w.bounds, first, "right") - 1
    count = np.diff(w.bounds)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        doc = np.concatenate([doc, short])
        h = np.concatenate([h, w.span_hashes(w.bounds[short], w.bounds[short + 1])])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(texts + 1))


#: What is added to a shingle for a set's first name and for its second.
_SALTS = U64(0x632BE59BD9B4E019), U64(0x9E6C63D0676A9A99)


def _digests(h: np.ndarray, bounds: np.ndarray, salt: np.uint64) -> np.ndarray:
    """64-bit name of each set."""
    sums = np.zeros(len(h) + 1, U64)
    np.cumsum(mix(h + salt), out=sums[1:])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(U64))


class _Names:
    """Names of sets: the first name, of so many bits, or the second where different sets share the first."""

    def __init__(self, bits: int, shared: np.ndarray):
        self.drop, self.shared = U64(64 - bits), shared

    def __call__(self, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        first = _digests(h, bounds, _SALTS[0]) >> self.drop
        if not len(self.shared):
            return first
        return np.where(np.isin(first, self.shared), _digests(h, bounds, _SALTS[1]), first)


def _parity(h: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A bitmap a set, as longs: each bit the parity of the shingles that fall on it.

    Two sets differ in at least as many shingles as their bitmaps do in bits.  A set
    has half as many bits as shingles or more, by powers of two from _BITS on, as
    bitmaps much smaller than the allowed difference could tell nothing.
    """
    size = np.diff(bounds)
    bits = _BITS << np.ceil(np.log2(np.maximum(size / (2 * _BITS), 1))).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(bits)])
    doc = np.repeat(np.arange(len(size)), size)
    spot = first[doc] + ((h >> U64(20)).astype(np.int64) & (bits[doc] - 1))
    odd = (np.bincount(spot, minlength=first[-1]) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array((first // 64).astype(np.int32)), pa.array(np.packbits(odd, bitorder="little").view(np.int64)))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, U64).view(np.int64))


def _describe(n: int, names: _Names):
    """Rows of documents (kind 0: id, node, second name, size, bits) and of the sketch (kind 1: bucket, count)."""
    columns = ["kind", "id", "node", "second", "n", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                h, bounds = _sets(data, offsets, n)
                sketch += np.bincount((h & U64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.zeros(j - i, np.int8)), batch.column(0).slice(i, j - i), _long(names(h, bounds)), _long(_digests(h, bounds, _SALTS[1])),
                        pa.array(np.diff(bounds).astype(np.int32)), _parity(h, bounds),
                    ],
                    names=columns,
                )
        at = np.flatnonzero(sketch)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.ones(len(at), np.int8)), pa.array(at.astype(np.int64)), pa.array(sketch[at]), pa.array(np.zeros(len(at), np.int64)),
                pa.array(np.zeros(len(at), np.int32)), pa.nulls(len(at), pa.list_(pa.int64())),
            ],
            names=columns,
        )

    return run


def _classes(rows: list) -> np.ndarray:
    """Rarity class of each counter: 0 up to four times the mean, then one more for each doubling."""
    counts = np.zeros(SKETCH)
    for r in rows:
        counts[r["id"]] = r["n"]
    mean = max(1.0, counts.sum() / SKETCH)
    return np.clip(np.floor(np.log2(np.maximum(counts / mean, 1))) - 1, 0, 31).astype(np.uint8)


def _order(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Global order of shingles, rare first; only the order and candidates rest on it, never a verdict."""
    return (classes[(h & U64(SKETCH - 1)).astype(np.int64)].astype(U64) << U64(58)) | (h >> U64(6))


def shared(percent: int) -> int:
    """Prefix tokens that two different linked sets share at least: three, or as many as the smallest such sets overlap in."""
    return 3 if percent >= 100 else max(1, min(3, -(-percent // (100 - percent))))


def _prefixes(n: int, percent: int, held, names: _Names):
    """(token, size, node, leads) of each set's first shingles in the global order.

    Two different linked sets share ``k = shared(percent)`` tokens among the first
    size - need(size, least partner) + k of the longer and, as the shorter leads, the
    first size - need(size, size) + k of it.  A task gives a set once for as
    long as it remembers it, however many of its documents have it.
    """
    k = shared(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, recent = held.value, np.zeros(_RECENT, U64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                h, bounds = _sets(data, offsets, n)
                size = np.diff(bounds)
                nodes = names(h, bounds)
                slot = (nodes & U64(_RECENT - 1)).astype(np.int64)
                fresh = np.zeros(len(nodes), bool)
                fresh[np.unique(nodes, return_index=True)[1]] = True
                fresh &= (size > 0) & (recent[slot] != nodes)
                recent[slot[fresh]] = nodes[fresh]
                doc = np.repeat(np.arange(len(size)), size)
                use = fresh[doc]
                key, doc = _order(h[use], classes), doc[use]
                order = np.lexsort((key, doc))
                key, doc = key[order], doc[order]
                at = np.arange(len(doc)) - np.searchsorted(doc, np.arange(len(size)))[doc]
                s = size[doc]
                take = at < s - -((-percent * s) // 100) + k
                leads = at < s - _need(s, s, percent) + k
                key, doc, leads = key[take], doc[take], leads[take]
                yield pa.RecordBatch.from_arrays([_long(key), pa.array(size[doc].astype(np.int32)), _long(nodes[doc]), pa.array(leads)], names=["token", "n", "node", "leads"])

    return run


class _Bucketed:
    """Candidates from rows sorted by (token, size, node).

    kind 0: a pair of small buckets and how many of them it shares; kind 1: a node of a
    large bucket, with its token; kind 2: a pair of a large bucket's pivot or chain.
    """

    def __init__(self, percent: int):
        self.percent = percent

    def pairs(self, token, n, node, leads) -> pa.RecordBatch | None:
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, n, node, leads = token[keep], n[keep], node[keep], leads[keep]
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.concatenate([start, [len(token)]]))
        of = np.repeat(size, size)
        many = of > 1
        token, n, node, leads, of = token[many], n[many], node[many], leads[many], of[many]
        if not len(token):
            return None
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        place = np.arange(len(token)) - np.repeat(start, np.diff(np.concatenate([start, [len(token)]])))
        rows = np.arange(len(token))
        large = of > SMALL_BUCKET
        left, right = [], []
        for lag in range(1, SMALL_BUCKET):
            x = rows[~large & (place + lag < of)]
            if not len(x):
                break
            left.append(x)
            right.append(x + lag)
        small = self.fitting(np.concatenate(left), np.concatenate(right), n, node, leads) if left else np.zeros((0, 2), np.int64)
        small, times = np.unique(small, axis=0, return_counts=True)
        # the pivot of a large bucket is its least node, so that the buckets of a group agree on it
        big = rows[large]
        first = start[np.diff(np.concatenate([start, [len(token)]])) > SMALL_BUCKET]
        pivot = np.zeros(0, np.int64)
        if len(big):
            bounds = np.searchsorted(big, first)
            by_node = np.lexsort((node[big], token[big]))
            pivot = np.repeat(big[by_node[bounds]], np.diff(np.concatenate([bounds, [len(big)]])))
        chain = big[place[big] + 1 < of[big]]
        a, b = np.concatenate([pivot, chain]), np.concatenate([big, chain + 1])
        a, b = np.minimum(a, b), np.maximum(a, b)
        star = np.unique(self.fitting(a[a != b], b[a != b], n, node, None), axis=0)
        kinds = [(0, small[:, 0], small[:, 1], times), (1, node[big], token[big], np.ones(len(big), np.int64)), (2, star[:, 0], star[:, 1], np.ones(len(star), np.int64))]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.full(len(x), k, np.int8) for k, x, _, _ in kinds])), *(pa.array(np.concatenate([row[c] for row in kinds])) for c in (1, 2, 3))],
            names=["kind", "a", "b", "times"],
        )

    def fitting(self, a, b, n, node, leads) -> np.ndarray:
        """Node pairs of rows a and b, b no shorter, whose sizes allow a link (and whose shorter one leads)."""
        fits = 100 * n[a].astype(np.int64) >= self.percent * n[b].astype(np.int64)
        if leads is not None:
            fits &= leads[a]
        return np.stack([node[a[fits]], node[b[fits]]], 1)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            rows = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            token = rows[0]
            if not len(token):
                continue
            cut = int(np.searchsorted(token, token[-1]))  # tokens come in ascending order
            if cut == 0:
                # repeats go first, so that a seam holds TREE different nodes and the part after it is a large bucket too
                rows = [x[np.append(True, rows[2][1:] != rows[2][:-1])] for x in rows]
                token = rows[0]
                if len(token) < 1 << 18:
                    held = rows
                    continue
            # a bucket of over 2**18 nodes is taken in parts that share a seam; the block round covers its other pairs
            out = self.pairs(*(x[: cut or len(token)] for x in rows))
            held = [x[cut:] if cut else x[-TREE:] for x in rows]
            if out is not None:
                yield out
        if held is not None:
            out = self.pairs(*held)
            if out is not None:
                yield out


def _across(percent: int, nearest: bool):
    """Close pairs of different components inside blocks of a large bucket; if ``nearest``, one for each node at most.

    Rows: token, cell, i, j, own, home, n, node, component, bits.  Pairs are compared by
    size and bitmap here, so only those that a link may join leave the block; guests of
    a cell do not meet there.
    """

    def pairs(rows: list[np.ndarray]) -> np.ndarray:
        i, j, own, home, n, node, component, bits = rows[2:]
        length = np.array([len(x) for x in bits])
        # unsigned, as numpy counts the bits of a negative number's absolute value
        whole = {k: np.stack([bits[x] for x in np.flatnonzero(length == k)]).view(U64) for k in np.unique(length)}
        at = np.zeros(len(n), np.int64)
        for k in whole:
            at[length == k] = np.arange((length == k).sum())
        half = {k: v[:, : k // 2] ^ v[:, k // 2 :] for k, v in whole.items()}
        out = []
        for x in np.flatnonzero(own == i):
            fit = (own == j) & (component != component[x]) & (home | home[x])
            if i[0] == j[0]:
                fit &= node > node[x]
            size = n.astype(np.int64)
            fit &= 100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x])
            k, close, bits_apart = length[x], [], []
            for other, mine, theirs in ((k, whole[k], whole), (2 * k, whole[k], half), (k // 2, half[k], whole)):
                y = np.flatnonzero(fit & (length == other))
                if len(y):
                    differ = np.bitwise_count(theirs[other][at[y]] ^ mine[at[x]]).sum(axis=1)
                    may = differ <= size[x] + size[y] - 2 * _need(size[x], size[y], percent)
                    close.append(y[may])
                    bits_apart.append(differ[may])
            y = np.concatenate(close) if close else np.zeros(0, np.int64)
            if nearest and len(y):
                y = y[[np.argmin(np.concatenate(bits_apart))]]
            if len(y):
                out.append(np.stack([np.full(len(y), node[x]), node[y]], 1))
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            rows = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if not len(rows[0]):
                continue
            edge = np.flatnonzero(np.any([x[1:] != x[:-1] for x in rows[:4]], axis=0)) + 1
            found = [pairs([x[lo:hi] for x in rows]) for lo, hi in zip(np.concatenate([[0], edge[:-1]]), edge, strict=False)] if len(edge) else []
            if found:
                p = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])
            held = [x[edge[-1] :] for x in rows] if len(edge) else rows
        if held is not None and len(held[0]):
            p = pairs(held)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    return run


def tree_links(probe: np.ndarray, sets: list[np.ndarray], percent: int) -> list[int]:
    """Which of the sets link with the probe; all are sorted in the global order.

    The sets in lexicographic order are a trie walked depth first: a set shares with
    the one before it the path of their common start and the overlaps counted along
    it.  A node is given up with all below it once its overlap and the elements that
    remain cannot reach what the link needs.
    """
    order = sorted(range(len(sets)), key=lambda k: sets[k].byteswap().tobytes())
    found, last, overlap, dead = [], np.zeros(0, U64), np.zeros(1, np.int64), -1
    for k in order:
        s = sets[k]
        need = _need(len(probe), len(s), percent)
        m = min(len(last), len(s))
        differ = np.flatnonzero(last[:m] != s[:m])
        shared = int(differ[0]) if len(differ) else m
        if 0 <= dead <= shared and overlap[dead] + len(s) - dead < need:
            continue  # the branch was pruned above this set
        shared = min(shared, len(overlap) - 1)
        tail = s[shared:]
        at = np.minimum(np.searchsorted(probe, tail), len(probe) - 1)
        overlap = np.concatenate([overlap[: shared + 1], overlap[shared] + np.cumsum(probe[at] == tail)])
        bound = overlap + np.arange(len(s), -1, -1)
        low = np.flatnonzero(bound < need)
        dead = int(low[0]) if len(low) else -1
        if dead >= 0:
            overlap = overlap[: dead + 1]
        else:
            found.append(k)
        last = s
    return found


def _verified(n: int, percent: int, held, names: _Names):
    """Links (a, b) of representatives; rows (probe, is_probe, node, id, text) sorted by (probe, probe first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = held.value
        probe_node, probe, probe_id = None, None, None
        sets: list[np.ndarray] = []
        ids: list[int] = []
        out: list[tuple[int, int]] = []

        def flush() -> None:
            if probe is not None and sets:
                out.extend((probe_id, ids[k]) for k in tree_links(probe, sets, percent))
            sets.clear()
            ids.clear()

        for batch in batches:
            groups, nodes, keys = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for i, j, data, offsets in chunks(batch.column(4)):
                h, bounds = _sets(data, offsets, n)
                found = names(h, bounds).view(np.int64).tolist()
                for k in range(j - i):
                    row = i + k
                    if found[k] != nodes[row]:
                        continue  # another row with the representative's id
                    own = h[bounds[k] : bounds[k + 1]]
                    own = own[np.argsort(_order(own, classes), kind="stable")]
                    rank = _order(own, classes)
                    if groups[row] != probe_node:
                        flush()
                        probe_node, probe = groups[row], None
                    if nodes[row] == probe_node:
                        probe, probe_id = rank, keys[row]
                    else:
                        sets.append(rank)
                        ids.append(keys[row])
                        if len(sets) >= TREE:
                            flush()
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                out.clear()
        flush()
        if out:
            a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _differing(a: str, b: str):
    """Bits in which two parity bitmaps differ; the longer one is folded to the shorter's length first."""
    half = lambda x: F.zip_with(F.slice(x, F.lit(1), (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2 + 1).cast("int"), F.size(x)), lambda p, q: p.bitwiseXOR(q))
    one = F.when(F.size(a) > F.size(b), half(a)).otherwise(F.col(a))
    two = F.when(F.size(b) > F.size(a), half(b)).otherwise(F.col(b))
    return F.aggregate(F.zip_with(one, two, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _cells(percent: int, n: str):
    """array<struct<cell, home>>: the size class of a set of n shingles, its home, and the class below, where it is a guest.

    Sets whose sizes allow a link are of one class or of neighbouring ones, so they meet in the home of the smaller.
    """
    if percent >= 100:
        return F.array(F.struct(F.col(n).cast("int").alias("cell"), F.lit(True).alias("home")))
    size = F.floor(F.log(n) / (1.0001 * math.log(100 / percent))).cast("int")  # a little wide, whatever the rounding
    return F.array(F.struct(size.alias("cell"), F.lit(True).alias("home")), F.struct((size - 1).alias("cell"), F.lit(False).alias("home")))


def near_duplicates(docs: DataFrame, *, n: int = 5, percent: int = 80, text: str = "text", id: str = "doc_id", name_bits: int = 64) -> DataFrame:
    """(id, n_shingles, component_id) of each row: groups by Jaccard links of word shingles.

    Words are white-space-parted and lower-cased (A-Z).  Two texts link when
    100 * intersection >= percent * union of their sets of distinct ``n``-word
    shingles (a text of fewer words: its whole sequence); a component is named by its
    smallest id.

    One pass describes each text (set size, two names of the set, parity bitmap)
    and counts shingles in a fixed sketch, which orders shingles from rare to
    frequent.  Equal sets are one node.  Each node goes, by the tokens of its prefix in
    that order, to the roots of the tree; buckets give candidate pairs, which size and
    bitmap bounds thin, and tries over the full sets decide them.  A bucket of more
    than SMALL_BUCKET nodes first gives a chain and pivots only; nodes that these
    leave in different components then meet in blocks of BLOCK nodes of the sizes that
    may link, so that a group of n copies costs about n pairs and no link between
    components is missed.

    Shingles are compared by 58 bits of hash inside a pair.  A set's first name has
    ``name_bits`` bits (fewer only test the rest); where sets of different second names
    share it, they take the second, so sets are told apart by both.  Such names are
    listed in the driver: with 64 bits, one is expected among six thousand million sets.
    Edge cases: null and empty texts have no shingle and are their own component;
    repeated rows get a row each; a null id has a null component unless linked; other
    columns are not read; an empty table gives an empty table.
    """
    base = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    described = kept(base.mapInArrow(trimmed(_describe(n, _Names(name_bits, np.zeros(0, U64)))), "kind byte, id long, node long, second long, n int, bits array<long>"))
    sketch = described.where("kind = 1").groupBy("id").agg(F.sum("node").alias("n")).collect()  # at most SKETCH rows
    held = spark.sparkContext.broadcast(_classes(sketch))
    rows = described.where("kind = 0")

    def grouped(rows: DataFrame) -> DataFrame:
        firsts = F.min("id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits")
        return kept(rows.where("n > 0").groupBy("node").agg(*firsts, (F.min("second") != F.max("second")).alias("shared")))

    classes = grouped(rows)
    shared_names = [r.node for r in classes.where("shared").select("node").collect()]
    if shared_names:
        release(classes)
        rows = rows.withColumn("node", F.when(F.col("node").isin(shared_names), F.col("second")).otherwise(F.col("node")))
        classes = grouped(rows)
    names = _Names(name_bits, np.array(shared_names, np.int64).view(U64))
    found = kept(
        base.select("text")
        .mapInArrow(trimmed(_prefixes(n, percent, held, names)), "token long, n int, node long, leads boolean")
        .repartition("token")
        .sortWithinPartitions("token", "n", "node")
        .mapInArrow(trimmed(_Bucketed(percent)), "kind byte, a long, b long, times long")
    )

    def links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        one = classes.select(F.col("node").alias("a"), F.col("id").alias("a_id"), F.col("n").alias("a_n"), F.col("bits").alias("a_bits"))
        two = classes.select(F.col("node").alias("b"), F.col("id").alias("b_id"), F.col("n").alias("b_n"), F.col("bits").alias("b_bits"))
        most = F.col("a_n") + F.col("b_n") - 2 * F.ceil(percent * (F.col("a_n") + F.col("b_n")) / F.lit(100 + percent))
        close = kept(pairs.join(one, "a").join(two, "b").where(_differing("a_bits", "b_bits") <= most).select("a", "b", "a_id", "b_id"))
        # a node with many partners meets them in several trees of about TREE sets, each with its own copy of the node
        trees = close.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TREE).alias("trees"))
        dealt = close.join(trees, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "trees"))
        probes = dealt.select("a", "salt", F.lit(0).alias("later"), F.col("a").alias("node"), F.col("a_id").alias("id")).distinct()
        partners = dealt.select("a", "salt", F.lit(1).alias("later"), F.col("b").alias("node"), F.col("b_id").alias("id"))
        out = kept(
            probes.union(partners)
            .join(texts, "id")
            .repartition("a", "salt")
            .sortWithinPartitions("a", "salt", "later")
            .select("a", "later", "node", "id", "text")
            .mapInArrow(trimmed(_verified(n, percent, held, names)), "a long, b long")
        )
        release(close)
        return out

    often = found.where("kind = 0").groupBy("a", "b").agg(F.sum("times").alias("times")).where(F.col("times") >= shared(percent))
    # texts meet their requests by a merge at every size, so that plans at small and large sizes are the same
    labels = components(links(often.select("a", "b").union(found.where("kind = 2").select("a", "b")).distinct(), base.hint("merge")))
    large = found.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("token")).distinct()
    # first each node with its nearest of another component, which joins most that can be joined; then all that are left
    for nearest in (True, False) if not large.isEmpty() else ():
        named = large.join(classes.select("node", "id", "n"), "node").join(labels.withColumnRenamed("node", "id"), "id", "left")
        named = kept(named.select("token", "node", F.coalesce("component", "id").alias("component"), F.explode(_cells(percent, "n")).alias("at")).select("token", "node", "component", "at.*"))
        cells = named.groupBy("token", "cell").agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("home").alias("any"))
        mixed = cells.where("lo <> hi AND any").select("token", "cell", F.ceil(F.col("c") / BLOCK).cast("int").alias("m"))
        blocks = named.join(mixed, ["token", "cell"]).join(classes.select("node", "n", "bits"), "node")
        met = kept(
            blocks.withColumn("own", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
            .select("token", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "home", "n", "node", "component", "bits")
            .repartition("token", "cell", "i", "j")
            .sortWithinPartitions("token", "cell", "i", "j")
            .mapInArrow(trimmed(_across(percent, nearest)), "a long, b long")
            .distinct()
        )
        release(named)
        if met.isEmpty():
            break
        labels = components(links(met, base), labels)
        release(met)
    release(found)
    named = classes.select("node", F.col("id").alias("rep")).join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return rows.select("id", "node", "n").join(named, "node", "left").select(
        F.col("id").alias(id), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("id")).alias("component_id")
    )


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, percent=85)
