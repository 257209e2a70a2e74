"""Sparse and dense retrieval, reciprocal rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text

from . import scan
from .index import B, K1, Index

#: Query vectors that one pass over the vectors is held against.
BLOCK_QUERIES = 4096


def query_terms(queries: DataFrame, query: str, columns: dict[str, Column]) -> DataFrame:
    """(qid, term) and the term's count in each named form of a query's text, in one pass over the queries."""
    def form(own: str) -> Column:
        return F.transform(text.tokens(columns[own]), lambda t: F.struct(t.alias("term"), *[F.lit(int(name == own)).alias(name) for name in columns]))

    each = queries.select(F.col(query).alias("qid"), F.explode(F.concat(*map(form, columns))).alias("t")).select("qid", "t.*")
    return each.groupBy("qid", "term").agg(*[F.sum(name).alias(name) for name in columns])


def scores(terms: DataFrame, index: Index, names: list[str], allowed: DataFrame | None = None) -> DataFrame:
    """(qid, doc) that share a term, with a score for each named count of query_terms: one meeting of terms and postings."""
    postings = index.postings if allowed is None or allowed.isEmpty() else index.postings.join(allowed.select("doc").distinct(), "doc", "left_semi")
    long = index.stats.crossJoin(F.broadcast(index.totals.select("avgdl"))).select("doc", (K1 * (1 - B + B * F.col("dl") / F.greatest(F.lit(1.0), "avgdl"))).alias("norm"))  # one row
    weighed = terms.join(index.terms.select("term", "idf"), "term").select("qid", "term", *[(F.col(n) * F.col("idf")).alias(n) for n in names])
    met = postings.join(long, "doc").join(weighed, "term")
    return met.groupBy("qid", "doc").agg(*[F.sum(F.col(n) * F.col("tf") * (K1 + 1) / (F.col("tf") + F.col("norm"))).alias(n) for n in names])


def own_scores(terms: DataFrame, index: Index, names: list[str]) -> DataFrame:
    """(qid, named scores) of each query for the one document ``qid.doc`` that it names: a row of terms meets one posting at most, whatever the number of documents."""
    long = index.stats.crossJoin(F.broadcast(index.totals.select("avgdl"))).select("doc", (K1 * (1 - B + B * F.col("dl") / F.greatest(F.lit(1.0), "avgdl"))).alias("norm"))  # one row
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + F.col("norm"))
    held = index.postings.join(long, "doc").join(index.terms.select("term", "idf"), "term").select("term", "doc", weight.alias("_weight"))
    met = terms.withColumn("doc", F.col("qid.doc")).join(held, ["term", "doc"])
    return met.groupBy("qid").agg(*[F.sum(F.col(n) * F.col("_weight")).alias(n) for n in names])


def bm25(queries: DataFrame, index: Index, query: str, column: str, allowed: DataFrame | None = None) -> DataFrame:
    """(qid, doc, score) of every pair that shares a term (R02, J07); repeats of a query's term count as often.

    Query terms are summed first; postings meet them by term.  allowed(doc) masks
    documents before scoring (F07); an empty one masks nothing.
    """
    return scores(query_terms(queries, query, {"score": F.col(column)}), index, ["score"], allowed)


def _masked(docs: DataFrame, doc: str, allowed: DataFrame | None) -> DataFrame:
    return docs if allowed is None or allowed.isEmpty() else docs.join(allowed.select(F.col("doc").alias(doc)).distinct(), doc, "left_semi")


def bm25_top(queries: DataFrame, docs: DataFrame, index: Index, query: str, doc: str, column: str, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(qid, doc, score, rank): the k best by bm25 (R03), without its table of pairs; docs are those of the index, with whole-number ids."""
    terms = query_terms(queries, query, {"score": F.col(column)})
    return top(scan.best(terms, _masked(docs, doc, allowed), index, k, doc, column), k)


def bm25_by_key(queries: DataFrame, docs: DataFrame, index: Index, query: str, doc: str, column: str, key: str, allowed: DataFrame | None = None) -> DataFrame:
    """(qid, key, n, total, best, shortest, longest): the pairs of bm25 summed by a key of the documents (A02), without their table."""
    terms = query_terms(queries, query, {"score": F.col(column)})
    return scan.by_key(terms, _masked(docs, doc, allowed), index, key, doc, column)


def top(scored: DataFrame, k: int, key: str = "doc", by: str = "qid", score: str = "score") -> DataFrame:
    """The k best of each query with their rank: score rounded to 9 places, then key."""
    order = Window.partitionBy(by).orderBy(F.round(score, 9).desc(), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_of(scored: DataFrame, targets: DataFrame, size: DataFrame) -> DataFrame:
    """(qid, target, score, rank) of the target among all documents (R05): those that share no term score 0.

    rank = 1 + better ones + equal ones of smaller key, so only scored pairs meet.
    size: the label space (doc), a code-sized list; zero rows are counted, not made.
    """
    return ranks_of(scored, targets, size, ["score"]).withColumnRenamed("score_rank", "rank")


def ranks_of(scored: DataFrame, targets: DataFrame, size: DataFrame, names: list[str]) -> DataFrame:
    """(qid, target) with each named score and its rank ``{name}_rank``, as rank_of gives them, from one reading of the scored pairs."""
    w = Window.partitionBy("qid", "target")
    pairs = targets.select("qid", "target").join(scored.select("qid", "doc", *[F.round(n, 9).alias(n) for n in names]), "qid", "left")
    own = pairs.withColumns({f"own_{n}": F.coalesce(F.max(F.when(F.col("doc") == F.col("target"), F.col(n))).over(w), F.lit(0.0)) for n in names})
    smaller = F.col("doc") < F.col("target")
    better = lambda n: F.count_if((F.col(n) > F.col(f"own_{n}")) | ((F.col(n) == F.col(f"own_{n}")) & smaller))
    counted = own.groupBy("qid", "target").agg(F.count_if(smaller).alias("_smaller"), *[F.max(f"own_{n}").alias(n) for n in names], *[better(n).alias(f"better_{n}") for n in names])
    place = size.select(F.col("doc").alias("target"), F.row_number().over(Window.orderBy("doc")).alias("at"))
    rank = lambda n: (1 + F.col(f"better_{n}") + F.when(F.col(n) == 0, F.col("at") - 1 - F.col("_smaller")).otherwise(0)).cast("long")
    return counted.join(place, "target").select("qid", "target", *names, *[rank(n).alias(f"{n}_rank") for n in names])


def dense(queries: DataFrame, vectors: DataFrame, k: int, query: str, doc: str, column: str, cosine: bool = True) -> DataFrame:
    """(qid, doc, score, rank) of the k nearest by cosine (R08) or dot product (R10); exact, in double.

    The stated queries are read in blocks of BLOCK_QUERIES; each block is one map over
    the vectors, some at a time, that keeps the k best of each task, so about k rows a task
    and query are shuffled, never all pairs.  A vector of norm zero scores 0.
    """
    spark = vectors.sparkSession

    def unit(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n == 0, 1, n)

    def nearest(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = held.value
            best, step = scan.Best(len(names), k), max(1, scan.TILE // len(names))
            for batch in batches:
                docs = batch.column(0).to_numpy()
                for a in range(0, batch.num_rows, step):
                    v = batch.column(1).slice(a, step).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, q.shape[1])
                    best.show(docs[a : a + step], q @ (unit(v) if cosine else v).T)
            query, docs, scores = best.found()
            for a in range(0, len(query), 1 << 16):
                s = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(names[query[s]]), pa.array(docs[s]), pa.array(scores[s])], names=["qid", "doc", "score"])

        return run

    blocks: list[DataFrame] = []
    ids, rows = [], []

    def close() -> None:
        held = spark.sparkContext.broadcast((np.array(ids, np.int64), unit(np.array(rows, np.float64)) if cosine else np.array(rows, np.float64)))
        blocks.append(vectors.select(F.col(doc).cast("long"), column).dropna().mapInArrow(nearest(held), "qid long, doc long, score double"))
        ids.clear(), rows.clear()

    for r in queries.select(F.col(query).cast("long"), column).dropna().orderBy(query).toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == BLOCK_QUERIES:
            close()
    if ids or not blocks:
        if not ids:
            return spark.createDataFrame([], "qid long, doc long, score double, rank int")
        close()
    out = blocks[0]
    for b in blocks[1:]:
        out = out.union(b)
    return top(out, k)


def rrf(lists: list[DataFrame], k: int, c: int = 60, key: str = "doc") -> DataFrame:
    """Reciprocal rank fusion of ranked lists (R11, P07): sum of 1 / (c + rank), k best of each query."""
    out = lists[0].select("qid", key, "rank")
    for x in lists[1:]:
        out = out.union(x.select("qid", key, "rank"))
    return top(out.groupBy("qid", key).agg(F.sum(1 / (c + F.col("rank"))).alias("score")), k, key)
