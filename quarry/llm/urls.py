"""URL filters: a path-template tree per host, judged by smoothed labelled purity.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import boxed, kept, release


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query's contract.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)

#: Children of a node beyond which those of less than SHARE of its rows are wildcards.
CHILDREN, SHARE = 16, 0.2
#: Standard errors by which a branch's purity must differ from its siblings' to stay apart.
APART = 2.0
#: Rows' worth of the host's (and, for hosts, of all rows') purity in a template's.
SMOOTH = 2.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for no ``://``."""
    known = F.contains(F.coalesce(url, F.lit("")), F.lit("://"))
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(known, lower).otherwise(""), F.when(known, path).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):  # later ones stand outside, so the longest wins
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _shape(segment: Column) -> Column:
    """A segment with its variable parts as wildcards: numbers, long hexadecimal strings."""
    s = F.regexp_replace(segment, r"(?<![0-9A-Za-z])[0-9a-fA-F-]{16,}(?![0-9A-Za-z])", "{hex}")
    return F.regexp_replace(s, r"[0-9]+", "{n}")


def _chains(at: DataFrame, node: list[str]) -> DataFrame:
    """Rows moved down to where the segments of their node's rows first differ; rows whose path ends before it, to their end."""
    longest = at.groupBy(*node).agg(F.max(F.struct(F.size("segments").alias("size"), "segments")).alias("m")).select(*node, F.col("m.segments").alias("longest"))
    same = F.zip_with("segments", F.slice("longest", 1, F.size("segments")), lambda a, b: a == b)
    shared = at.join(longest, node).groupBy(*node).agg(F.min(F.nullif(F.array_position(same, False), F.lit(0)) - 1).alias("shared"))
    steps = F.least("shared", F.size("segments")).cast("int")  # least passes over null: no two rows differ
    down = at.join(shared, node).withColumn("steps", steps)
    chain = F.when(F.col("steps") > 0, F.concat(F.lit("/"), F.array_join(F.slice("segments", 1, F.col("steps")), "/"))).otherwise("")
    return down.withColumns({"template": F.concat("template", chain), "segments": F.slice("segments", F.col("steps") + 1, F.size("segments"))}).select(*at.columns)


def _branches(at: DataFrame, node: list[str]) -> DataFrame:
    """Rows moved one level down, to the child of their node that keeps its name or to the wildcard."""
    at = at.withColumn("segment", F.element_at("segments", F.lit(1)))
    child = at.groupBy(*node, "segment").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    whole = child.groupBy(*node).agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("all_n"), F.sum("l").alias("all_l"), F.sum("b").alias("all_b"))
    rest_l, rest_b = F.col("all_l") - F.col("l"), F.col("all_b") - F.col("b")
    pooled = (F.col("all_b") + 1) / (F.col("all_l") + 2)
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(F.col("l"), F.lit(1)) + 1 / F.greatest(rest_l, F.lit(1))))
    told = (F.col("l") > 0) & (rest_l > 0)
    differs = told & (F.abs(F.col("b") / F.col("l") - rest_b / rest_l) > APART * error)
    small = (F.col("children") > CHILDREN) & (F.col("n") < SHARE * F.col("all_n"))
    named = child.join(whole, node).select(*node, "segment", F.when(differs | ~(told | small), F.col("segment")).otherwise("*").alias("name"))
    down = at.join(named, [*node, "segment"])
    return down.withColumns({"template": F.concat("template", F.lit("/"), "name"), "segments": F.slice("segments", 2, F.size("segments"))}).drop("segment", "name")


def templates(rows: DataFrame) -> DataFrame:
    """(host, _shape, n, labelled, blocked, template) of distinct (host, _shape, segments, n, labelled, blocked).

    A child that is alone stays, so rows go down at once to where the segments of their
    node first differ.  There the node's children are counted: one whose blocked share
    differs from its siblings' by APART standard errors stays; one that does not differ
    merges with them.  Where labels cannot tell, as the child or its siblings have none, it
    is a wildcard if its node has many children and it is a small one, and stays otherwise.
    Rows are only ever summed by (host, template so far, segment); paths that have ended
    take no further part.  There are as many rounds as forks on one path, however long it is.
    """
    node = ["host", "template"]
    at = rows.withColumn("template", F.lit(""))
    ended, tables = [at.where(F.size("segments") == 0)], []
    at = at.where(F.size("segments") > 0)
    for move in itertools.cycle((_chains, _branches)):
        if at.isEmpty():
            break
        moved = kept(move(at, node))  # the next step reads it three times
        tables.append(moved)
        ended.append(moved.where(F.size("segments") == 0).select(*at.columns))
        at = moved.where(F.size("segments") > 0)
    tree = kept(reduce(DataFrame.unionByName, ended).drop("segments"))
    release(*tables)
    return tree


def judge(pages: DataFrame, *, rules: tuple[Rule, ...] = RULES, url: str = "url", reject: float = 0.5) -> DataFrame:
    """Adds host, path, rule, template, purity and verdict to ``pages``.

    Urls that a rule fits have its verdict and are the labels.  Each host has a tree
    of path templates; a template's purity is its share of labelled rows that are
    blocked, smoothed by its host's, which is smoothed by all rows'.  A url without a
    rule is blocked if its host has labelled rows and its template's purity exceeds ``reject``.

    Rows meet by (host, shape of the path), summed beforehand, so a hot host costs its
    distinct shapes; the join back to the rows splits like any skewed join.  Edge cases:
    null urls and urls without ``://`` have empty host and path and form one template;
    repeated rows are judged alike and count each; without labels all purities are 0 and
    nothing is blocked; an empty table gives an empty one; columns with the added names
    are replaced.
    """
    pages, columns = boxed(pages, {"_url": url}, ("host", "path", "rule", "template", "purity", "verdict"))
    host, path = host_and_path(F.col("_url"))
    rows = pages.select("box", "_url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_verdict": verdict, "_shape": _shape(F.col("path"))})
    shapes = rows.groupBy("host", "_shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("_verdict").alias("labelled"), F.sum(F.when(F.col("_verdict") == "block", 1).otherwise(0)).alias("blocked")
    )
    summed = kept(shapes.withColumn("segments", F.filter(F.split("_shape", "/"), lambda s: s != "")))
    tree = templates(summed)
    release(summed)
    by_template = tree.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    by_host = by_template.groupBy("host").agg(F.sum("l").alias("host_l"), F.sum("b").alias("host_b"))
    overall = by_host.agg((F.sum("host_b") / F.greatest(F.sum("host_l"), F.lit(1))).alias("base"))
    pure = (
        by_template.join(by_host, "host").crossJoin(F.broadcast(overall))  # one row
        .withColumn("_host", (F.col("host_b") + SMOOTH * F.col("base")) / (F.col("host_l") + SMOOTH))
        .select("host", "template", "host_l", F.coalesce((F.col("b") + SMOOTH * F.col("_host")) / (F.col("l") + SMOOTH), F.lit(0.0)).alias("purity"))
    )
    known = tree.select("host", "_shape", "template").join(pure, ["host", "template"])
    return rows.join(known, ["host", "_shape"], "left").select(
        *columns, "host", "path", "rule", "template", F.round("purity", 9).alias("purity"),
        F.coalesce("_verdict", F.when((F.col("host_l") > 0) & (F.round("purity", 9) > reject), "block").otherwise("allow")).alias("verdict"),
    )


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "template", "purity")
