"""Words of Arrow arrays against the column function, and counts of an index by one reading of the texts."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions import text, words
from quarry.operators import index, retrieve, scan

ODD = [
    None, "", "The one", "ab abc abcd", "12abc 1a2 99 9ab9 a1 a12", "ABCé Éabc naïveté x-ray don't", "Kelvin İstanbul ſtop ﬁne", "abc\x00def\nghi\tjkl",
    "abc", "def", "zz9", "9zz", "the THE The thes", "日本語abc日本語", "a" * 5000, "😀word😀", "abc" + "9" * 40, "9" * 40 + "abc", "under_score snake_case",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    return ODD + ["".join(rng.choices("abZ09 .é_\n", k=rng.randrange(40))) for _ in range(400)] + [" ".join(rng.choices(["the", "Alpha", "beta2", "2gamma", "ab"], k=9)) for _ in range(50)]


@pytest.mark.parametrize("chunk", [1, 37, 1 << 21])
def test_words_are_those_of_the_column_function(spark, texts, monkeypatch, chunk):
    monkeypatch.setattr(words, "CHUNK", chunk)
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", text.tokens(F.col("text")).alias("w"))
    want = {r.id: r.w for r in frame.collect()}
    array, got = pa.array(["cut off", *texts], pa.string()).slice(1), {i: [] for i in range(len(texts))}
    for a, b in words.slices(array, 50):
        found, at = words.words(array.slice(a, b - a))
        for w, i in zip(found.to_pylist(), at, strict=True):
            if w not in text.STOP_WORDS:
                got[a + i].append(w)
    assert got == want


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_counts_of_the_terms_that_are_asked(texts, block, monkeypatch, spark):
    monkeypatch.setattr(scan, "BLOCK_TERMS", block)
    ix = index.build(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3), "id", "text")
    asked = ["alpha", "beta2", "gamma", "unheard", "abc", "def", "naïvet", "kelvin", "stanbul", "a" * 5000, "bbb", "aaa"]
    got = {r.term: (r.df, r.words) for r in scan._counts(spark.createDataFrame([(w,) for w in asked * 2], "term string"), ix.texts).collect()}
    assert got.pop(None) == (len(texts), sum(r.dl for r in ix.stats.collect()))
    assert got == {r.term: (r.df, None) for r in ix.terms.where(F.col("term").isin(asked)).collect()} and len(got) > 5


def test_scores_by_key_need_two_readings_of_the_documents(spark):
    """One for the counts and one for the scores; words, totals and scores had one each."""
    readings = spark.sparkContext.accumulator(0)

    def count(batches):
        readings.add(1)
        yield from batches

    docs = spark.createDataFrame([(1, "alpha beta the beta", "x"), (2, None, "x"), (3, "gamma alpha", None)], "id long, text string, key string").coalesce(1)
    queries = spark.createDataFrame([(7, "beta gamma"), (8, "unheard")], "q long, text string")
    watched = docs.mapInArrow(count, docs.schema)
    got = retrieve.bm25_by_key(queries, watched, index.build(watched, "id", "text"), "q", "id", "text", "key").collect()
    assert {(r.qid, r.key, r.n, r.shortest, r.longest) for r in got} == {(7, "x", 1, 3, 3), (7, None, 1, 2, 2)}
    assert readings.value == 2
