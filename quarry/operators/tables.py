"""Relational helpers: first seen, primary documents, keys in one table and not in another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import codes


def first_seen(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order (Q11)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def primary_document(files: DataFrame, by: str, pos: str) -> DataFrame:
    """The best project document of each key: earliest pattern, newest version, largest, first."""
    named = files.withColumn("pattern", codes.name_rank(F.col("name"))).where("pattern IS NOT NULL")
    order = Window.partitionBy(by).orderBy("pattern", F.desc("version"), F.desc("size"), pos)
    return named.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def missing(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def text_of(asked: DataFrame, sections: DataFrame, bodies: DataFrame) -> DataFrame:
    """(gid, found): each id's text by preference (R19): masked section, section, body, short text; empty ones are passed over.

    asked: gid; sections: gid, redacted, section; bodies: gid, body, text.  A body of
    nothing gives an empty text, an id that is in neither table a null.
    """
    some = lambda *names: F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in names))
    first = sections.select("gid", some("redacted", "section").alias("_first"))
    last = bodies.select("gid", F.coalesce(some("body", "text"), F.lit("")).alias("_last"))
    return asked.select("gid").join(first, "gid", "left").join(last, "gid", "left").select("gid", F.coalesce("_first", "_last").alias("found"))
