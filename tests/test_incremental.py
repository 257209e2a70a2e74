"""An index appended to by micro-batches: restarts, a run that breaks off, and retrieval from it."""

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from quarry.operators import index, retrieve
from quarry.streaming import incremental

SCHEMA = "doc_id long, text string"


def summed(ix):
    terms = {r.term: (r.df, round(r.idf, 9)) for r in ix.terms.collect()}
    postings = sorted(map(tuple, ix.postings.select("term", "doc", "tf").collect()))
    total = ix.totals.first()
    return terms, postings, sorted(map(tuple, ix.stats.select("doc", "dl").collect())), (total.n, round(total.avgdl, 9))


def test_restarts_and_a_broken_run_count_nothing_twice(spark, tmp_path, monkeypatch):
    texts = [None, "", "solar wind wind farm", "the wind of change", "biomass stove " * 400] + [f"word{chr(97 + k % 7)} common term{chr(97 + k % 3)}" for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    places = [f"{tmp_path}/{x}" for x in ("in", "index", "checkpoint")]
    go = lambda: incremental.catch_up_index(spark, places[0], SCHEMA, places[1], places[2], "doc_id", "text", files=2)
    whole = DataFrameWriter.parquet

    def broken(self, path, *args, **kwargs):
        if "/totals/" in path:
            raise OSError("lost")
        return whole(self, path, *args, **kwargs)

    for k in range(3):
        docs.where(F.col("doc_id") % 3 == k).repartition(3).write.mode("append").parquet(places[0])
        if k == 1:
            with monkeypatch.context() as m:
                m.setattr(DataFrameWriter, "parquet", broken)
                with pytest.raises(Exception, match="lost"):
                    go()
            before = incremental.landed_index(spark, places[1])
            assert before.totals.first().n == docs.where("doc_id % 3 = 0").count() == before.stats.count()
        assert go() >= 2
        assert go() == 0
    got, want = incremental.landed_index(spark, places[1]), index.build(docs, "doc_id", "text")
    assert summed(got) == summed(want)
    asked = spark.createDataFrame([(1, "wind stove"), (2, "common termb")], "q long, t string")
    score = lambda ix: sorted((r.qid, r.doc, round(r.score, 9)) for r in retrieve.bm25(asked, ix, "q", "t").collect())
    assert score(got) == score(want)
