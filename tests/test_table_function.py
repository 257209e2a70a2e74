"""The table function against the same fusion as a plan."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarry.operators import fusion
from quarry.plans import table_function


@pytest.fixture(scope="module")
def candidates(spark):
    table_function.register(spark)
    df = spark.range(3000).selectExpr("id % 60 AS qid", "IF(id % 2 = 0, 'bm25', 'dense') AS channel", "concat('c', (id * 7 + id DIV 60) % 23) AS code", "CAST((id * 37) % 101 AS DOUBLE) AS score", "id AS more")
    df = df.groupBy("qid", "channel", "code").agg(F.max("score").alias("score"), F.max("more").alias("more"))
    df = df.union(spark.createDataFrame([(99, "bm25", "a", 1.0, 0), (99, "bm25", "b", 1.0, 0)], df.schema))
    df.createOrReplaceTempView("candidates")
    return df


def test_same_rows_as_the_plan(spark, candidates):
    got = spark.sql("SELECT * FROM recommend_codes(TABLE(candidates), 5, map('bm25', 0.7D, 'dense', 0.3D))")
    channel = lambda n: candidates.where(F.col("channel") == n).select("qid", "code", "score")
    want = fusion.fuse([(channel("bm25"), 0.7), (channel("dense"), 0.3)], 5)
    key = lambda df: sorted((r.qid, r["rank"], r.code, round(r.score, 9)) for r in df.collect())
    assert key(got) == key(want) and got.dtypes == [("qid", "bigint"), ("code", "string"), ("score", "double"), ("rank", "int")]


def test_rows_meet_by_query(spark, candidates):
    plan = spark.sql("SELECT * FROM recommend_codes(TABLE(candidates), 5, map('bm25', 1.0D))")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid" in plan


@pytest.mark.parametrize(
    ("call", "said"),
    [
        ("recommend_codes(TABLE(SELECT qid, channel, code FROM candidates), 5, map('a', 1.0D))", "needs a column score"),
        ("recommend_codes(TABLE(SELECT qid, channel, code, 'x' AS score FROM candidates), 5, map('a', 1.0D))", "found string"),
        ("recommend_codes(TABLE(candidates), 0, map('a', 1.0D))", "positive"),
        ("recommend_codes(TABLE(candidates), 5, 'a')", "map of channels"),
    ],
)
def test_analyze_checks_its_arguments(spark, candidates, call, said):
    with pytest.raises(PySparkException, match=said):
        spark.sql(f"SELECT * FROM {call}").collect()
