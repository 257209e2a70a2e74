"""Ranks of rows' own keys against those by a table of pairs, and the rows that they shuffle."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import index, own_rank, retrieve
from quarry.plans import retrieval_queries

TEXTS = [
    ("k1", "solar grid power grid"), ("k2", "wind farm power ACM0002 applies"), ("k3", "power grid"), ("k1", None), ("k2", ""), ("k10", "solar grid power grid"),
    ("k4", "xyz unmatched"), ("k5", "..."), ("k3", "ACM0002 wind wind wind solar"), ("k1", "redacted methodology_ref wind ACM0002"),
]


@pytest.mark.parametrize("held", [0, 14, 1 << 20])
def test_own_ranks_are_those_by_pairs(spark, held):
    docs = spark.createDataFrame([(k, *x) for k, x in enumerate(TEXTS)], "id long, code string, text string")
    forms = {"before": F.col("text"), "after": F.regexp_replace("text", "ACM0002", "REDACTED")}
    ix = index.build(docs, "code", "text", parts=True)
    pairs = retrieve.scores(retrieve.query_terms(docs, "id", forms), ix, list(forms))
    want = retrieve.ranks_of(pairs, docs.select(F.col("id").alias("qid"), F.col("code").alias("target")), ix.stats, list(forms))
    got = own_rank.own_ranks(docs, "code", "text", forms, held=held)
    columns = ["before_rank", "after_rank"]
    assert sorted(map(tuple, got.select("key", *columns).collect())) == sorted(map(tuple, want.select("target", *columns).collect()))


def test_own_ranks_of_no_rows(spark):
    none = spark.createDataFrame([], "code string, text string")
    assert own_rank.own_ranks(none, "code", "text", {"own": F.col("text")}).count() == 0


def test_rank_leak_makes_no_row_for_each_document_and_code(spark, tmp_path):
    words = [f"word{k}" for k in range(40)]
    docs = spark.createDataFrame([(k, f"src{k % 3}", "en", " ".join(words)) for k in range(600)], "doc_id long, source string, lang string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.executorSummary("driver").totalShuffleWrite()
    got = retrieval_queries.rank_leak(spark, str(tmp_path)).collect()
    assert sum(r.n for r in got) == 600
    assert store.executorSummary("driver").totalShuffleWrite() - before < 600 * 600  # bytes; a row for each of 97 codes takes several times as many


@pytest.mark.parametrize("share", [1, 5, 1 << 20])
def test_own_totals_are_the_scores_of_own_terms(spark, monkeypatch, share):
    monkeypatch.setattr(own_rank, "SHARE", share)
    monkeypatch.setattr(own_rank, "EACH", min(8, share - 1))
    docs = spark.createDataFrame([(k, *x) for k, x in enumerate(TEXTS)], "id long, code string, text string")
    forms = {"before": F.col("text"), "after": F.regexp_replace("text", "ACM0002", "REDACTED")}
    own = docs.withColumn("own", F.struct("id", F.col("code").alias("doc")))
    scores = retrieve.own_scores(retrieve.query_terms(own, "own", forms), index.build(docs, "code", "text", parts=True), list(forms))
    want = own.join(scores.withColumnRenamed("qid", "own"), "own", "left").select("code", F.coalesce("before", F.lit(0.0)), F.coalesce("after", F.lit(0.0)))
    got = own_rank.own_totals(docs.union(spark.createDataFrame([(99, None, "solar grid")], docs.schema)), "code", "text", forms)
    rounded = lambda rows: sorted((r[0], round(r[1], 9), round(r[2], 9)) for r in rows)
    assert rounded(got.where("key IS NOT NULL").collect()) == rounded(want.collect())
    assert [tuple(r) for r in got.where("key IS NULL").collect()] == [(None, 0.0, 0.0)]


def test_score_drop_makes_no_row_for_each_document_and_term(spark, tmp_path):
    words = [f"word{k}" for k in range(300)]
    docs = spark.createDataFrame([(k, f"src{k % 3}", "en", " ".join(words)) for k in range(2400)], "doc_id long, source string, lang string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.executorSummary("driver").totalShuffleWrite()
    got = retrieval_queries.score_drop(spark, str(tmp_path)).collect()
    assert sum(r.n for r in got) == 2400
    assert store.executorSummary("driver").totalShuffleWrite() - before < 2400 * 1000  # bytes; a row for each of 300 terms takes several times as many
