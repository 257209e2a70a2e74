"""Typed edges (src, kind, dst), and paths through them as joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources import landed


@dataclass(frozen=True)
class Step:
    """One edge of a kind to the node named ``to``, from dst to src if ``back``; ``any``: no edge or any number of them; ``least``: of the nodes that it leads to, the least alone."""

    kind: str
    to: str
    back: bool = False
    any: bool = False
    least: bool = False


def _hops(edges: DataFrame, step: Step) -> DataFrame:
    a, b = ("dst", "src") if step.back else ("src", "dst")
    hops = edges.where(F.col("kind") == step.kind).select(F.col(a).alias("_from"), F.col(b).alias("_to")).dropna()
    return hops.groupBy("_from").agg(F.min("_to").alias("_to")) if step.least else hops.distinct()


def reach(starts: DataFrame, hops: DataFrame) -> DataFrame:
    """(start, node, depth): nodes that hops(_from, _to) lead to from each distinct start(node), with the fewest hops; itself at 0.

    A round follows the nodes that the last one found first, and drops those seen before,
    so cycles end.  Rounds are written and read again: as many as the longest of the
    shortest paths.  A table of pairs is the result; ask it of the starts that are wanted.
    """
    spark = starts.sparkSession
    folder = landed.folder(spark)
    schema, levels = None, []
    new = starts.select(F.col(starts.columns[0]).alias("start")).dropna().distinct().withColumns({"node": F.col("start"), "depth": F.lit(0)})
    while True:
        schema = schema or new.schema
        path = f"{folder}/{len(levels)}"
        new.write.parquet(path)
        held = spark.read.schema(schema).parquet(path)
        if held.isEmpty():
            break
        levels.append(held)
        near = held.join(hops.dropna(), F.col("node") == F.col("_from")).select("start", F.col("_to").alias("node")).distinct()
        seen = reduce(DataFrame.unionAll, levels).select("start", "node")
        new = near.join(seen, ["start", "node"], "left_anti").select("start", "node", F.lit(len(levels)).alias("depth"))
    return reduce(DataFrame.unionAll, levels or [held])


def match(starts: DataFrame, edges: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """The starts' column and a column for each step: every path of the pattern, once.

    A step is an equi-join with the edges of its kind, repeated edges counting once; one of
    any length meets the reach of the nodes that stand before it.  Names of steps are
    distinct, and none is the starts' column.  Null ends of edges and null starts lead nowhere;
    kinds without edges give no path, but steps of any length stay where they are.  A step to the
    least node is for what asks for the least node first: each path before it goes on once,
    where a node with many edges in and out would make a path of each two.
    """
    out = starts.select(starts.columns[0]).dropna().distinct()
    for step in steps:
        if step.any and step.least:
            raise ValueError("a step of any length has no least node")
        at, hops = out.columns[-1], _hops(edges, step)
        if step.any:
            hops = reach(out.select(at), hops).select(F.col("start").alias("_from"), F.col("node").alias("_to"))
        out = out.join(hops, F.col(at) == F.col("_from")).select(*out.columns, F.col("_to").alias(step.to))
    return out


def described(paths: DataFrame, node: str, facts: DataFrame, key: str) -> DataFrame:
    """Paths with the facts of a node; paths of nodes without facts are dropped, as a pattern that names an attribute asks for it."""
    return paths.join(facts.withColumnRenamed(key, node), node)


def first_of(paths: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """One path of each ``by``, the least by ``order``: the point read of a fact (S16), for all starts at once."""
    rest = [*order, *(c for c in paths.columns if c != by and c not in order)]
    return paths.groupBy(by).agg(F.min(F.struct(*rest)).alias("_m")).select(by, *(f"_m.{c}" for c in rest))
