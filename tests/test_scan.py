"""Scores by one reading of the documents against the table of pairs."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import index, retrieve, scan

WORDS = "alpha beta gamma delta epsilon zeta eta2 theta iota kappa".split()


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(scan, "BLOCK_QUERIES", 5)


@pytest.fixture(scope="module")
def frames(spark):
    text = lambda i: " ".join(WORDS[(i * (j + 3) + j * j) % (10 - i % 3)] for j in range(i % 17))
    docs = [(i, None if i % 29 == 7 else text(i), None if i % 11 == 3 else f"k{i % 4}") for i in range(300)]
    queries = [(i, text(i + 1)) for i in range(12)] + [(50, None), (51, "unheard"), (52, "alpha alpha unheard beta")]
    return spark.createDataFrame(docs, "id long, text string, key string").repartition(3), spark.createDataFrame(queries, "q long, text string")


def _pairs(frames):
    docs, queries = frames
    return retrieve.bm25(queries, index.build(docs, "id", "text"), "q", "text")


def test_best_of_each_query_without_a_table_of_pairs(frames, small):
    docs, queries = frames
    got = retrieve.bm25_top(queries, docs, index.build(docs, "id", "text"), "q", "id", "text", 7)
    want = {(r.qid, r.doc): (r.rank, pytest.approx(r.score)) for r in retrieve.top(_pairs(frames), 7).collect()}
    assert {(r.qid, r.doc): (r.rank, r.score) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # postings and query terms do not meet in a shuffle


def test_sums_by_key_without_a_table_of_pairs(frames, small):
    docs, queries = frames
    ix = index.build(docs, "id", "text")
    got = retrieve.bm25_by_key(queries, docs, ix, "q", "id", "text", "key")
    pairs = _pairs(frames).join(docs.select(F.col("id").alias("doc"), "key"), "doc").join(ix.stats, "doc")
    want = pairs.groupBy("qid", "key").agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.max("score").alias("best"), F.min("dl").alias("shortest"), F.max("dl").alias("longest"))
    row = lambda r: (r.n, pytest.approx(r.total), pytest.approx(r.best), r.shortest, r.longest)
    assert {(r.qid, r.key): (r.n, r.total, r.best, r.shortest, r.longest) for r in got.collect()} == {(r.qid, r.key): row(r) for r in want.collect()}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_task_keeps_the_best_of_all_it_is_shown():
    import numpy as np

    rng = np.random.default_rng(1)
    scores, kept = np.round(rng.random((6, 400)), 2), scan.Best(6, 9)
    for a in range(0, 400, 50):
        kept.show(np.arange(a, a + 50), scores[:, a : a + 50])
        kept._settle()
    query, docs, _ = kept.found()
    for q in range(6):
        assert list(docs[query == q]) == list(np.lexsort((np.arange(400), -scores[q]))[:9])


def test_scores_for_the_document_that_a_query_names(spark):
    docs = spark.createDataFrame([("a", "alpha beta beta"), ("b", "beta gamma"), ("c", None)], "code string, text string")
    asked = spark.createDataFrame([(1, "a", "alpha beta"), (2, "b", "beta beta"), (3, "a", "unheard"), (4, "c", "beta")], "id long, code string, text string")
    ix = index.build(docs, "code", "text", parts=True)
    named = asked.withColumn("own", F.struct("id", F.col("code").alias("doc")))
    got = {r.qid.id: r.x for r in retrieve.own_scores(retrieve.query_terms(named, "own", {"x": F.col("text")}), ix, ["x"]).collect()}
    codes = {1: "a", 2: "b", 3: "a", 4: "c"}
    want = {r.qid: r.score for r in retrieve.bm25(asked, ix, "id", "text").collect() if codes[r.qid] == r.doc}
    assert got == {k: pytest.approx(v) for k, v in want.items()} and set(got) == {1, 2}
