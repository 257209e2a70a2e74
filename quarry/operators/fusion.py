"""Score fusion, ensembles, routers and re-rankers over ranked lists (qid, key, score, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import keywords

from .filters import scale_fits
from .retrieve import top


def rolled_up(scored: DataFrame, keys: DataFrame, doc: str = "doc", key: str = "code") -> DataFrame:
    """Best score of each key, at least 0."""
    return scored.join(keys.select(doc, key), doc).groupBy("qid", key).agg(F.greatest(F.lit(0.0), F.max("score")).alias("score"))


def min_max(score: str, by: str = "qid") -> Column:
    """Score scaled to 0..1 within a query; all 0 where scores are equal."""
    w = Window.partitionBy(by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi - lo < 1e-9, 0.0).otherwise((F.col(score) - lo) / (hi - lo))


def fuse(channels: list[tuple[DataFrame, float]], k: int, excluded: DataFrame | None = None, multipliers: DataFrame | None = None, key: str = "code") -> DataFrame:
    """Weighted sum of min-max channels (P02): missing is 0; excluded keys stretch the scale and then go; multipliers default to 1."""
    parts = None
    for frame, weight in channels:
        one = frame.select("qid", key, (weight * min_max("score")).alias("part"))
        parts = one if parts is None else parts.union(one)
    out = parts.groupBy("qid", key).agg(F.sum("part").alias("score"))
    if excluded is not None:
        out = out.join(excluded, [c for c in ("qid", key) if c in excluded.columns], "left_anti")
    if multipliers is not None:
        out = out.join(multipliers.select("qid", key, "multiplier"), ["qid", key], "left").withColumn("score", F.col("score") * F.coalesce("multiplier", F.lit(1.0))).drop("multiplier")
    return top(out, k, key)


def match_counts(candidates: DataFrame, features: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds excluded and match_count, 0 to 4, to candidates(qid, code) by features(qid, scale, scope, technology, gases).

    texts(code, text): the keys that a code's texts mention are found text by text and are
    distinct before they meet the candidates, by code and key; texts are not shuffled.
    Only keys with keywords of their own are matched here.  Queries without features match nothing.
    """
    facts = texts.select("code", F.explode(keywords.mentioned(F.col("text"))).alias("x")).select("code", "x.dimension", "x.key").distinct()
    both = candidates.join(features, "qid", "left")
    one = lambda d, k: F.struct(F.lit(d).alias("dimension"), k.alias("key"))
    gases = F.transform(F.coalesce("gases", F.array().cast("array<string>")), lambda g: one("ghg", g))
    asked = both.select("qid", "code", F.explode(F.concat(F.array(one("scope", F.col("scope")), one("technology", F.col("technology")), one("scale", F.col("scale"))), gases)).alias("x"))
    met = asked.select("qid", "code", "x.dimension", "x.key").join(facts, ["code", "dimension", "key"]).groupBy("qid", "code")
    met = met.agg(F.count_distinct(F.when(F.col("dimension") != "scale", F.col("dimension"))).alias("n"), F.max((F.col("dimension") == "scale").cast("int")).alias("said"))
    small = F.col("code").startswith("AMS-")
    scale = F.coalesce(F.when(F.col("scale") == "small", small | (F.coalesce("said", F.lit(0)) == 1)).when(F.col("scale") == "large", ~small), F.lit(False))
    counted = both.join(met, ["qid", "code"], "left")
    return counted.select("qid", "code", F.coalesce(~scale_fits(F.col("scale"), F.col("code")), F.lit(False)).alias("excluded"), (F.coalesce("n", F.lit(0)) + scale.cast("int")).cast("long").alias("match_count"))


def fusion_only(sparse: DataFrame, dense: DataFrame, features: DataFrame, texts: DataFrame, k: int = 5, *, weights: tuple[float, float, float] = (0.5, 0.5, 0.0)) -> DataFrame:
    """The best codes of each query with match_count (P17): both channels' candidates, min-max, less what is excluded, and match counts as a third channel.

    sparse and dense are (qid, code, score), rolled up by code from the best clauses of each.
    """
    found = match_counts(sparse.select("qid", "code").union(dense.select("qid", "code")).distinct(), features, texts)
    channels = [(sparse, weights[0]), (dense, weights[1])]
    if weights[2]:
        channels.append((found.where("NOT excluded").select("qid", "code", F.col("match_count").cast("double").alias("score")), weights[2]))
    best = fuse(channels, k, excluded=found.where("excluded").select("qid", "code"))
    return best.join(found.select("qid", "code", "match_count"), ["qid", "code"])


def weighted_rrf(a: DataFrame, b: DataFrame, wa: float, wb: float, k: int, c: int = 60, key: str = "code") -> DataFrame:
    """Two lists by weighted reciprocal rank; absent means one after the list's last."""
    size = lambda x, n: x.groupBy("qid").agg(F.max("rank").alias(n))
    both = a.select("qid", key, F.col("rank").alias("ra")).join(b.select("qid", key, F.col("rank").alias("rb")), ["qid", key], "full")
    both = both.join(size(a, "na"), "qid", "left").join(size(b, "nb"), "qid", "left")
    ra, rb = F.coalesce("ra", F.coalesce("na", F.lit(0)) + 1), F.coalesce("rb", F.coalesce("nb", F.lit(0)) + 1)
    return top(both.select("qid", key, (wa / (c + ra) + wb / (c + rb)).alias("score")), k, key)


def borda(lists: list[DataFrame], k: int, points: int = 6, key: str = "code") -> DataFrame:
    """Borda count: max(0, points - rank)."""
    out = lists[0].select("qid", key, "rank")
    for x in lists[1:]:
        out = out.union(x.select("qid", key, "rank"))
    return top(out.groupBy("qid", key).agg(F.sum(F.greatest(F.lit(0), points - F.col("rank"))).cast("double").alias("score")), k, key)


def routed(a: DataFrame, b: DataFrame, wins: list, k: int, c: int = 60, key: str = "code") -> DataFrame:
    """System b's first if it is one that b wins, else a's; the other places by rank fusion without it (P10)."""
    first = lambda x, n: x.where("rank = 1").select("qid", F.col(key).alias(n))
    head = first(a, "fa").join(first(b, "fb"), "qid", "full").select("qid", F.when(F.col("fb").isin(wins), F.col("fb")).otherwise(F.coalesce("fa", "fb")).alias(key))
    both = a.select("qid", key, "rank").union(b.select("qid", key, "rank")).groupBy("qid", key).agg(F.sum(1 / (c + F.col("rank"))).alias("score"))
    rest = top(both.join(head, ["qid", key], "left_anti"), k - 1, key).select("qid", key, (F.col("rank") + 1).alias("rank"))
    return head.select("qid", key, F.lit(1).alias("rank")).union(rest)


def or_unrouted(out: DataFrame, a: DataFrame, b: DataFrame, k: int, key: str = "code") -> DataFrame:
    """``out`` and, for queries that it has no row of, the first k of a, or of b where a has none."""
    without = lambda x, done: x.where(F.col("rank") <= k).select("qid", key, "rank").join(done.select("qid").distinct(), "qid", "left_anti")
    return out.select("qid", key, "rank").union(without(a, out)).union(without(without(b, out), a))


def judged(a: DataFrame, b: DataFrame, verdicts: DataFrame, k: int, c: int = 60, key: str = "code") -> DataFrame:
    """(qid, key, rank): where the first places of two lists differ, a judge's choice comes first, a's where it made none; else the common first.

    verdicts: qid, choice (null or absent: none).  The other places by rank fusion without the first.
    """
    first = lambda x, n: x.where("rank = 1").select("qid", F.col(key).alias(n))
    both = first(a, "fa").join(first(b, "fb"), "qid", "full").join(verdicts.select("qid", "choice"), "qid", "left")
    chosen = F.when((F.col("fa") != F.col("fb")) & F.col("choice").isNotNull(), F.col("choice")).otherwise(F.coalesce("fa", "fb"))
    head = both.select("qid", chosen.alias(key))
    scores = a.select("qid", key, "rank").union(b.select("qid", key, "rank")).groupBy("qid", key).agg(F.sum(1 / (c + F.col("rank"))).alias("score"))
    rest = top(scores.join(head, ["qid", key], "left_anti"), k - 1, key).select("qid", key, (F.col("rank") + 1).alias("rank"))
    return head.select("qid", key, F.lit(1).alias("rank")).union(rest)


def slot_rerank(ranked: DataFrame, key: str = "code") -> DataFrame:
    """Permutes only the places that members of the query's group hold, by ``new_score``.

    ranked: qid, key, rank, member, new_score.  Ties keep their order; others keep their place.
    """
    within = Window.partitionBy("qid", "member")
    at = ranked.withColumn("slot", F.row_number().over(within.orderBy("rank"))).withColumn("turn", F.row_number().over(within.orderBy(F.round("new_score", 9).desc(), "rank")))
    slots = at.where("member").select("qid", F.col("slot").alias("turn"), F.col("rank").alias("new_rank"))
    moved = at.where("member").join(slots, ["qid", "turn"]).select("qid", key, F.col("new_rank").alias("rank"))
    return at.where("NOT member").select("qid", key, "rank").union(moved)


def budgeted(lines: DataFrame, by: str, order: str, line: str, budget: int, extra: int = 1) -> DataFrame:
    """Lines of each key joined until the first that would overflow the budget."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    kept = lines.withColumn("_used", F.sum(F.length(line) + extra).over(w)).where(F.col("_used") <= budget)
    return kept.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l")))), lambda x: x["l"]), "\n").alias("block"), F.count(F.lit(1)).alias("n_lines"))
