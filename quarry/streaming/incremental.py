"""Incremental ingestion: new files once, as a stream that stops when it has caught up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import index


def postings(docs: DataFrame, doc: str, column: str) -> DataFrame:
    """(doc, terms array<struct<term,tf>>, dl) of each document by itself: no state between batches."""
    words = docs.select(F.col(doc).alias("doc"), F.sort_array(text.tokens(F.col(column))).alias("w")).withColumn("dl", F.size("w"))
    places = F.when(F.col("dl") > 0, F.sequence(F.lit(0), F.col("dl") - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    runs = words.withColumn("s", starts)
    terms = F.transform("s", lambda i, k: F.struct(F.get("w", i).alias("term"), (F.coalesce(F.get("s", k + 1), F.col("dl")) - i).alias("tf")))
    return runs.select("doc", terms.alias("terms"), "dl")


def catch_up(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, doc: str, column: str) -> int:
    """Appends postings of files that no earlier run has read (S31, L07); returns the rows read.

    The source's checkpoint remembers files, so a run that breaks off resumes and no row is written twice.
    """
    stream = spark.readStream.schema(schema).parquet(folder)
    q = postings(stream, doc, column).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(int(p["numInputRows"]) for p in q.recentProgress)


def catch_up_index(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, doc: str, column: str, *, files: int = 10_000) -> int:
    """Appends postings, document frequencies and totals of files that no earlier run has read; returns the micro-batches landed.

    A micro-batch of at most ``files`` files has folders of its own, named by its number, and totals come
    last.  A run that breaks off has its unfinished batch read again, with the same
    files under the same number, and written over: nothing counts twice.  ``out`` and
    ``checkpoint`` belong together.  Each row is a document; ids are expected to be unique.
    """
    landed = []

    def land(batch: DataFrame, number: int) -> None:
        at = {name: f"{out}/{name}/batch={number}" for name in ("postings", "terms", "totals")}
        postings(batch, doc, column).write.mode("overwrite").parquet(at["postings"])
        held = batch.sparkSession.read.parquet(at["postings"])
        held.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(at["terms"])
        held.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).write.mode("overwrite").parquet(at["totals"])
        landed.append(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(landed)


def landed_index(spark: SparkSession, out: str) -> index.Index:
    """The index of all that has landed: statistics summed over finished micro-batches, texts not read again.

    A batch without totals is unfinished and left out.  At least one must have landed.
    """
    totals = spark.read.parquet(f"{out}/totals")
    finished = totals.select("batch")
    rows = spark.read.parquet(f"{out}/postings").join(finished, "batch", "left_semi")
    whole = totals.agg(F.sum("n").alias("n"), (F.sum("tokens") / F.sum("n")).alias("avgdl"))
    df = spark.read.parquet(f"{out}/terms").join(finished, "batch", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    terms = df.crossJoin(F.broadcast(whole)).select("term", "df", index.idf(F.col("n"), F.col("df")).alias("idf"))  # one row
    return index.Index(rows.select("doc", F.inline("terms")).select("term", "doc", F.col("tf").cast("long").alias("tf")), rows.select("doc", F.col("dl").cast("long").alias("dl")), terms, whole)
