"""Embedding of texts by a model: batches within limits, retries, and a cap on the whole run's cost agreed before it starts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Transport = Callable[[list[str]], list[list[float]]]
#: Tokens and texts of a request, attempts at one, and the longest pause between them in seconds.
BATCH_TOKENS, BATCH_TEXTS, ATTEMPTS, LONGEST_WAIT = 100_000, 128, 5, 30
#: Ranges that the order of a run is cut into (hexadecimal digits of the digest).
RANGE_DIGITS = 3


def tokens(text: Column) -> Column:
    """A model's tokens, estimated: four signs each, one at least; an empty text has none."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4)


def within_cap(docs: DataFrame, id: str, text: str, cap: int) -> DataFrame:
    """(id, text, tokens, covered): rows in the order of a digest of their id, covered while all tokens so far keep within ``cap``.

    The running sum is taken in two steps: within ranges of the digest, and over the ranges'
    sums (4,096 rows), so it is the same under any partitioning and passes no single task.
    """
    digest = F.md5(F.coalesce(F.col(id).cast("string"), F.lit("")))
    own = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), tokens(F.col(text)).alias("tokens"), digest.alias("_digest")).withColumn("_range", F.substring("_digest", 1, RANGE_DIGITS))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("_range").agg(F.sum("tokens").alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    run = F.sum("tokens").over(Window.partitionBy("_range").orderBy("_digest", "id").rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("_run", run).join(sums, "_range").select("id", "text", "tokens", (F.col("_before") + F.col("_run") <= cap).alias("covered"))


def embedded(
    docs: DataFrame, id: str, text: str, transport: Transport, *, cap: int, batch_tokens: int = BATCH_TOKENS, batch_texts: int = BATCH_TEXTS, wait: float = 1.0
) -> DataFrame:
    """(id, vector, reason): a vector, or why there is none: ``empty``, ``cap``, ``too long`` (for a request) or ``failed``.

    Which rows the cap covers is settled for the whole run before a task asks anything, so no
    partitioning and no retried task goes beyond it but by what it asks again.  A request has
    at most ``batch_tokens`` tokens and ``batch_texts`` texts; it is tried ATTEMPTS times, with
    pauses of 1, 2, 4 ... seconds times ``wait``, and then its rows have failed.  Rows of one id
    are rows each for itself; every input has a row.
    """

    def ask(batch: list[tuple]) -> pd.DataFrame:
        vectors = None
        for k in range(ATTEMPTS):
            try:
                vectors = transport([t for _, t in batch])
                break
            except Exception:  # whatever a remote model fails with is tried again
                if k + 1 < ATTEMPTS:
                    time.sleep(min(2**k, LONGEST_WAIT) * wait)
        if vectors is None or len(vectors) != len(batch):
            return pd.DataFrame({"id": [i for i, _ in batch], "vector": [None] * len(batch), "reason": "failed"})
        return pd.DataFrame({"id": [i for i, _ in batch], "vector": vectors, "reason": None})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, size = [], 0
        for f in frames:
            for i, t, n in zip(f["id"], f["text"], f["tokens"], strict=True):
                if batch and (size + n > batch_tokens or len(batch) == batch_texts):
                    yield ask(batch)
                    batch, size = [], 0
                batch.append((i, t))
                size += n
        if batch:
            yield ask(batch)

    placed = within_cap(docs, id, text, cap)
    reason = F.when(F.col("tokens") == 0, "empty").when(F.col("tokens") > batch_tokens, "too long").when(~F.col("covered"), "cap")
    schema = f"id {docs.schema[id].dataType.simpleString()}, vector array<double>, reason string"
    asked = placed.where(reason.isNull()).select("id", "text", "tokens").mapInPandas(run, schema)
    rest = placed.where(reason.isNotNull()).select("id", F.lit(None).cast("array<double>").alias("vector"), reason.alias("reason"))
    return asked.union(rest).withColumnRenamed("id", id)
