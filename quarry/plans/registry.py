"""Registration of queries and the inputs that they share.

An input is SQL that both Spark and an ANSI engine read alike, so that a query and
its oracle start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; sql is its oracle, if SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of an input; the tables it names are read by the given folder."""
    for name in TABLES:
        if name in sql:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def digits(x: str, n: int) -> str:
    return f"lpad(CAST({x} AS STRING), {n}, '0')"


#: A methodology code for each part, of every family and some of none.
CODES = f"""
SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice,
  CASE CAST(p_partkey % 9 AS INT)
    WHEN 0 THEN concat('ACM', {digits('p_partkey % 10000', 4)})
    WHEN 1 THEN concat('AM', {digits('p_partkey % 10000', 4)})
    WHEN 2 THEN concat('AMS-', CASE p_partkey % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'II' ELSE 'III' END, '.', chr(CAST(65 + p_size % 8 AS INT)), '.')
    WHEN 3 THEN concat('VM', {digits('p_partkey % 10000', 4)})
    WHEN 4 THEN concat('VMR', {digits('p_partkey % 10000', 4)})
    WHEN 5 THEN concat('GS-EN-', {digits('p_partkey % 1000', 3)})
    WHEN 6 THEN concat('40', CAST(p_partkey % 10 AS STRING), '-', CAST(p_size % 3 AS STRING))
    WHEN 7 THEN concat('AR-AM', {digits('p_partkey % 10000', 4)})
    ELSE 'TPDDTEC' END AS code
FROM part
"""

#: A document with a methodology code spliced into it, a version after it and paragraphs by blank lines.
SPLICED = f"""
SELECT doc_id, source, lang,
  concat(substr(text, 1, 200), ' applies ',
    CASE CAST(doc_id % 6 AS INT)
      WHEN 0 THEN concat('ACM', {digits('doc_id % 100', 4)})
      WHEN 1 THEN concat('AMS-I.', chr(CAST(65 + doc_id % 5 AS INT)), '.')
      WHEN 2 THEN concat('VM', {digits('doc_id % 50', 4)})
      WHEN 3 THEN 'TPDDTEC'
      WHEN 4 THEN concat('GS-EN-', {digits('doc_id % 90', 3)})
      ELSE 'no code' END,
    ' version 2. Next sentence here.', chr(10), chr(10), substr(text, 201)) AS text,
  CASE CAST(doc_id % 6 AS INT)
      WHEN 0 THEN concat('ACM', {digits('doc_id % 100', 4)})
      WHEN 1 THEN concat('AMS-I.', chr(CAST(65 + doc_id % 5 AS INT)), '.')
      WHEN 2 THEN concat('VM', {digits('doc_id % 50', 4)})
      WHEN 3 THEN 'TPDDTEC'
      WHEN 4 THEN concat('GS-EN-', {digits('doc_id % 90', 3)})
      ELSE 'NONE' END AS code
FROM documents
"""
