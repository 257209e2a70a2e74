"""Reproducible shuffles, splits, quotas and dedupes.

Order comes from a digest of seed and key, so it is the same in any engine and
under any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ticket(key: str, seed: int = 42) -> Column:
    """What a seeded shuffle sorts by."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))


def quota(df: DataFrame, stratum: str, key: str, sizes: dict[str, int], seed: int = 42) -> DataFrame:
    """The first rows of each stratum's shuffle up to its quota."""
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col(stratum))
    n = F.row_number().over(Window.partitionBy(stratum).orderBy(ticket(key, seed), key))
    return df.withColumn("pos", n).where(F.col("pos") <= F.coalesce(limit, F.lit(0)))


def split(df: DataFrame, stratum: str, key: str, val_size: int, seed: int = 42) -> DataFrame:
    """Adds split (val or test): ``val_size`` rows to val in the strata's shares, halves to even, and what that leaves over or lacks to the last stratum.

    A null stratum is a stratum, the first; a stratum gives no more rows than it has.
    """
    counts = df.groupBy(F.col(stratum).alias("_stratum")).agg(F.count(F.lit(1)).alias("_n"))  # a row a stratum
    whole = Window.partitionBy()
    share = F.bround(val_size * F.col("_n") / F.sum("_n").over(whole)).cast("long")
    last = F.row_number().over(Window.orderBy(F.desc("_stratum"))) == 1
    quotas = counts.withColumns({"_share": share, "_last": last}).withColumn("_quota", F.when(F.col("_last"), val_size - F.sum(F.when(~F.col("_last"), F.col("_share")).otherwise(0)).over(whole)).otherwise(F.col("_share")))
    n = F.row_number().over(Window.partitionBy(stratum).orderBy(ticket(key, seed), key))
    both = df.withColumn("_place", n).join(quotas.select("_stratum", "_quota"), F.col(stratum).eqNullSafe(F.col("_stratum")))
    return both.withColumn("split", F.when(F.col("_place") <= F.col("_quota"), "val").otherwise("test")).drop("_stratum", "_quota", "_place")


def sizes(pools: DataFrame, target: int) -> DataFrame:
    """Adds size: the pool's share of ``target``, halves to even (E05).  pools: n, a row each."""
    return pools.withColumn("size", F.bround(target * F.col("n") / F.sum("n").over(Window.partitionBy())).cast("long"))


def round_robin(df: DataFrame, cell: list[str], key: str, n: int, always: str | None = None, seed: int = 42) -> DataFrame:
    """Rows for a pilot (E03): all that meet the condition ``always``, then others in turn from sorted cells, each shuffled, until there are n.

    More than n rows come back only where ``always`` alone has more.
    """
    first = F.coalesce(F.expr(always), F.lit(False)) if always else F.lit(False)
    taken = df.where(first)
    turn = df.where(~first).withColumn("turn", F.row_number().over(Window.partitionBy(*cell).orderBy(ticket(key, seed), key)))
    return taken.withColumn("turn", F.lit(0)).union(turn.orderBy("turn", *cell, key).limit(max(0, n - (taken.count() if always else 0))))


def _programs(df: DataFrame, program: str, date: str, key: str) -> tuple[DataFrame, Window]:
    group = F.coalesce(F.col(program).cast("string"), F.concat(F.lit("NOPOA:"), F.col(key).cast("string")))
    order = Window.partitionBy(group).orderBy(F.coalesce(F.col(date).cast("string"), F.lit("9999-99-99")), key)
    return df.withColumn("_n", F.row_number().over(order)), order


def one_per_program(df: DataFrame, program: str, date: str, key: str) -> DataFrame:
    """The earliest of each program, smaller key first; a null program is a program of its own."""
    return _programs(df, program, date, key)[0].where("_n = 1").drop("_n")


def dropped_of_programs(df: DataFrame, program: str, date: str, key: str) -> DataFrame:
    """(program, kept, dropped): a row for each one that one_per_program drops, with the one it keeps."""
    numbered, order = _programs(df, program, date, key)
    kept = numbered.withColumn("_kept", F.first(key).over(order))
    return kept.where("_n > 1").select(F.col(program).alias("program"), F.col("_kept").alias("kept"), F.col(key).alias("dropped"))


def without_replacement(queries: DataFrame, space: DataFrame, k: int, seed: int) -> DataFrame:
    """(qid, code, rank, score): k codes for each query at random, each at most once (R18); fewer where there are fewer codes.

    Codes are numbered, and for each place j of the last k a draw below j + 1 is taken, or
    j itself if that draw came up before; draws are digests of seed, query and place.  So a
    query makes k rows, whatever the size of the space.
    """
    numbered = space.select("code").distinct().withColumn("at", F.row_number().over(Window.orderBy("code")) - 1)
    n = numbered.agg(F.count(F.lit(1)).alias("n"))
    draw = lambda j: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "qid", j)), 1, 8), 16, 10).cast("long") % (j + 1)
    pick = F.aggregate(
        F.sequence(F.greatest(F.col("n") - k, F.lit(0)), F.col("n") - 1), F.array().cast("array<long>"),
        lambda seen, j: F.concat(seen, F.array(F.when(F.array_contains(seen, draw(j)), j).otherwise(draw(j)))),
    )
    picked = queries.select("qid").crossJoin(F.broadcast(n)).where("n > 0").select("qid", F.posexplode(pick).alias("place", "at"))  # one row
    return picked.join(numbered, "at").select("qid", "code", (F.col("place") + 1).alias("rank"), (1.0 / (F.col("place") + 1)).alias("score"))
