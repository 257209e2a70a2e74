"""Quality classifier: random-indexing word vectors, pooled, then a two-layer network with a temperature."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import _BYTE_POWERS, _BYTE_VALUES, U64, chunks, mix, trimmed

#: Labelled rows that the model is fitted on, at most: those of least hash.
SAMPLE_ROWS = 6_000
#: Buckets of tokens, and numbers in a vector.
BUCKETS, WIDTH, HIDDEN = 1 << 14, 64, 32
_CAPITALS, _AGAIN, _SIGNS = 0, 1, 2  # reserved buckets; signs take 256 from the third on
_WORDS = 258

_KIND = np.ones(256, np.uint8)  # 0 white space, 1 letters and digits, 2 signs
_KIND[list(b" \t\n\x0b\x0c\r")] = 0
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 2
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, np.int64)
_LOWER[97:123] = 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each token, bounds of the texts).

    Tokens are runs of letters and digits and runs of signs.  A run of capitals is one
    token whatever it says, and so is a token inside three in a row that the text had before.
    """
    n, texts = len(data), len(offsets) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(texts + 1, np.int64)
    kind = _KIND[data]
    head = np.zeros(n, bool)
    head[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]) | head)
    end = np.concatenate([start[1:], [n]])
    use = kind[start] > 0
    start, end = start[use], end[use]
    up, down = _BYTE_POWERS.get(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE_VALUES[data] * up[:n], out=sums[1:])
    size = end - start
    h = mix((sums[end] - sums[start]) * down[start] + size.astype(U64) * U64(0xA24BAED4963EE407))
    count = lambda flags: (lambda c: c[end] - c[start])(np.concatenate([[0], np.cumsum(flags[data])]))
    capitals = (count(_UPPER) > 1) & (count(_LOWER) == 0)
    sign = kind[start] == 2
    bucket = np.where(sign, _SIGNS + (h % U64(256)).astype(np.int64), _WORDS + (h % U64(BUCKETS - _WORDS)).astype(np.int64))
    bucket[capitals & ~sign] = _CAPITALS
    bounds = np.searchsorted(start, offsets)
    bounds[-1] = len(start)
    if len(h) > 3:
        doc = np.searchsorted(bounds, np.arange(len(h)), "right")
        three = mix(h[:-2] + U64(3) * h[1:-1] + U64(7) * h[2:]) + mix(doc[:-2].astype(U64))
        order = np.argsort(three, kind="stable")
        old = np.zeros(len(three), bool)
        old[order[1:]] = (three[order[1:]] == three[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
        old &= doc[:-2] == doc[2:]
        again = np.zeros(len(h), bool)
        for k in range(3):
            again[k : len(h) - 2 + k] |= old
        bucket[again] = _AGAIN
    return bucket, bounds


def index_vectors() -> np.ndarray:
    """A sparse vector for each bucket: four places of +1 or -1, by hash."""
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    rows = np.arange(BUCKETS, dtype=U64)
    for k in range(4):
        h = mix(rows * U64(0x9E3779B97F4A7C15) + U64(k + 1))
        out[rows.astype(np.int64), (h % U64(WIDTH)).astype(np.int64)] += np.where((h >> U64(40)) & U64(1), 1, -1)
    return out


def _pool(vectors: np.ndarray, bucket: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean vector of each text's tokens, and the logarithm of their number."""
    out = np.zeros((len(bounds) - 1, WIDTH + 1), np.float32)
    n = np.diff(bounds)
    full = np.flatnonzero(n)
    if len(full):
        out[full, :WIDTH] = np.add.reduceat(vectors[bucket], bounds[full], axis=0) / n[full, None]
    out[:, WIDTH] = np.log1p(n) / 10
    return out


@dataclass
class Model:
    """Word vectors and network; ``prior`` stands where there was nothing to learn from."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    prior: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(offsets) - 1, self.prior)
        bucket, bounds = tokens(data, offsets)
        z = self.logits(_pool(self.vectors, bucket, bounds).astype(np.float64)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _empty(prior: float) -> Model:
    z = np.zeros(0)
    return Model(z, z, z, z, z, z, 0.0, 1.0, prior)


def _context_vectors(streams: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Random indexing: a bucket's vector sums its neighbours' index vectors, left ones rotated, and its own."""
    index = index_vectors()
    left = np.roll(index, 1, axis=1)
    total = np.zeros_like(index)
    for bucket, bounds in streams:
        same = np.ones(max(len(bucket) - 1, 0), bool)
        same[bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(bucket))] - 1] = False
        a, b = bucket[:-1][same], bucket[1:][same]
        for target, source in ((b, left[a]), (a, index[b])):
            order = np.argsort(target, kind="stable")
            t = target[order]
            if len(t):
                first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
                total[t[first]] += np.add.reduceat(source[order], first, axis=0)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    total /= np.maximum(norm, 1e-6)
    return total + index / np.linalg.norm(index, axis=1, keepdims=True).clip(1e-6)


def train(texts: pa.Array, labels: np.ndarray, seed: int = 7) -> Model:
    """Fits vectors and network; every fifth row calibrates the temperature."""
    if not len(labels) or labels.min() == labels.max():
        return _empty(float(labels[0]) if len(labels) else 0.5)
    streams = [(b.astype(np.int32), e) for _, _, data, offsets in chunks(texts) for b, e in [tokens(data, offsets)]]
    vectors = _context_vectors(streams)
    x = np.concatenate([_pool(vectors, b, e) for b, e in streams]).astype(np.float64)
    y = labels.astype(np.float64)
    held = np.arange(len(y)) % 5 == 4
    mean, scale = x[~held].mean(0), x[~held].std(0) + 1e-6
    r = np.random.default_rng(seed)
    p = [r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    fit, target = (x[~held] - mean) / scale, y[~held]
    for _ in range(60):
        order = r.permutation(len(fit))
        for at in range(0, len(fit), 128):
            a, b = fit[order[at : at + 128]], target[order[at : at + 128]]
            hidden = np.tanh(a @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -50, 50))) - b) / len(b)
            back = np.outer(error, p[2]) * (1 - hidden**2)
            grads = [a.T @ back + 1e-4 * p[0], back.sum(0), hidden.T @ error + 1e-4 * p[2], np.array([error.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 3e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    model = Model(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if held.any():
        z, target = model.logits(x[held]), y[held]
        grid = np.geomspace(0.25, 8, 41)
        loss = [np.mean(np.logaddexp(0, z / s) - target * z / s) for s in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def _held_out(id: str):
    """Rows that are never learned from: crc32 of the id as text divisible by five, or no id."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", text: str = "text", id: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most ``sample_rows`` labelled rows that are not held out, chosen by the least hash of their id.

    The ids are chosen from the labels alone and broadcast (a row each, so bounded);
    one task reads the chosen texts and trains, and the model (about 4 MB) comes to the driver.
    An id labelled twice has the mean as its label; labels of null are not used.
    """
    own = labels.select(F.col(id).alias("_id"), F.col(label).cast("double").alias("_label")).dropna()
    chosen = (
        own.where(~_held_out("_id")).groupBy("_id").agg(F.avg("_label").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    )
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), pa.schema([("_id", pa.int64()), ("_text", pa.string()), ("_label", pa.float64())]))
        rows = rows.sort_by([("_id", "ascending"), ("_text", "ascending")]).combine_chunks()
        model = train(rows["_text"].combine_chunks(), rows["_label"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = rows.select(F.col("_id").cast("long"), "_text", "_label").repartition(1).mapInArrow(trimmed(one), "model binary").collect()
    return pickle.loads(found[0][0]) if found else _empty(0.5)


def score(docs: DataFrame, model: Model, *, threshold: float = 0.3, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Adds held_out, score and predicted to ``docs``: the calibrated probability of label 1, and whether it reaches ``threshold``.

    Only the text is read for a score.  Rows are independent: no shuffle.  Edge cases:
    null and empty texts are scored as texts without tokens; repeated rows score alike;
    an empty label table, or labels of one kind, give that label's constant score (0.5
    where there is none); a null id is held out; columns with the added names are replaced.
    """
    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.score(data, offsets) for _, _, data, offsets in chunks(batch.column(at), 1 << 18)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else np.zeros(0))], names=[*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)
    scored = docs.select(*names).mapInArrow(trimmed(run), schema + ", score double")
    return scored.select(*names, _held_out(id).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("text")
