"""Evaluation: rates by stratum, paired comparison, groups, purity, bootstrap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quarry.functions import stats


def by_stratum(ranks: DataFrame, stratum: str, fixed: list[str]) -> DataFrame:
    """Metrics overall and for each of the fixed strata, zeros where there is no row."""
    rolled = ranks.groupingSets([[stratum], []], stratum).agg(*stats.metrics(F.col("rank"))).withColumn(stratum, F.coalesce(stratum, F.lit("overall")))
    names = ranks.sparkSession.createDataFrame([(x,) for x in ["overall", *fixed]], f"{stratum} string")
    return names.join(rolled, stratum, "left").fillna(0)


def paired(a: DataFrame, b: DataFrame, key: str = "qid") -> DataFrame:
    """Two systems' hits on the rows both have (J03, M04, M13): n, rates, b, c, statistic and p."""
    both = a.select(key, F.col("hit").alias("ha")).join(b.select(key, F.col("hit").alias("hb")), key)
    counted = both.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("ha").cast("int")).alias("rate_a"), F.avg(F.col("hb").cast("int")).alias("rate_b"),
        F.count_if(F.col("ha") & ~F.col("hb")).alias("b"), F.count_if(~F.col("ha") & F.col("hb")).alias("c"),
    )
    return counted.withColumn("chi2", stats.mcnemar(F.col("b"), F.col("c"))).withColumn("p", stats.chi_p("chi2"))


def against(runs: DataFrame, baseline: str) -> DataFrame:
    """Runs on the queries that the baseline has too, with hits at one (h1) and in five (h5) and the baseline's (b1, b5).

    runs: condition, qid, rank (null: not among the five), and what subsets are cut by.
    """
    first, found = F.coalesce(F.col("rank") == 1, F.lit(False)), F.col("rank").isNotNull()
    base = runs.where(F.col("condition") == baseline).select("qid", first.alias("b1"), found.alias("b5"))
    return runs.withColumns({"h1": first, "h5": found}).join(base, "qid")


def by_subset(both: DataFrame, subsets: dict[str, Column]) -> DataFrame:
    """Each condition against the baseline on each subset (M13): rates with intervals, difference, b, c and statistic.

    A row counts in every subset whose condition holds; a subset without rows has no line.
    """
    names = F.array_compact(F.array(*[F.when(c, name) for name, c in subsets.items()]))
    h, b = F.col("h1"), F.col("b1")
    k = both.select("condition", "h1", "b1", F.explode(names).alias("subset")).groupBy("condition", "subset").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(b).alias("kb"), F.count_if(h).alias("kc"), F.count_if(b & ~h).alias("b"), F.count_if(h & ~b).alias("c")
    )
    (bl, bh), (cl, ch) = stats.wilson(F.col("kb"), F.col("n")), stats.wilson(F.col("kc"), F.col("n"))
    rate = {"base": F.col("kb") / F.col("n"), "base_low": bl, "base_high": bh, "cond": F.col("kc") / F.col("n"), "cond_low": cl, "cond_high": ch, "delta": (F.col("kc") - F.col("kb")) / F.col("n")}
    return k.select("condition", "subset", "n", *[F.round(x, 6).alias(name) for name, x in rate.items()], "b", "c", F.round(stats.mcnemar(F.col("b"), F.col("c")), 6).alias("chi2"))


def condition_report(both: DataFrame, baseline: str, subsets: dict[str, Column]) -> DataFrame:
    """A line a condition (M14): rates, differences and statistics overall and on subsets, empty answers; the baseline has no differences."""
    h, b = F.col("h1"), F.col("b1")
    delta = lambda c, x="h1", y="b1": F.avg(F.when(c, F.col(x).cast("int") - F.col(y).cast("int")))
    chi2 = lambda c: stats.mcnemar(F.count_if(c & b & ~h), F.count_if(c & h & ~b))
    every = F.lit(True)
    apart = {"delta_top1": delta(every), "chi2": chi2(every), "delta_top5": delta(every, "h5", "b5")}
    for name, c in subsets.items():
        apart |= {f"delta_{name}": delta(c), f"chi2_{name}": chi2(c)}
    k = both.groupBy("condition").agg(
        F.round(F.avg(h.cast("int")), 6).alias("top1"), F.round(F.avg(F.col("h5").cast("int")), 6).alias("top5"), *[F.round(x, 6).alias(name) for name, x in apart.items()], F.count_if("empty").alias("n_empty")
    )
    return k.withColumns({name: F.when(F.col("condition") != baseline, F.col(name)) for name in apart})


def diagnose(candidates: DataFrame, truths: DataFrame, k: int = 10) -> DataFrame:
    """What the filter before fusion costs (M16), one row.

    Ceiling (truths among the k kept), small-scale truths excluded by the scale rule,
    candidates whose match count is full or nearly so, and truths that the plain
    system puts first but the filter loses.  candidates: gid, code, rank, matches (0
    to 4), excluded; truths: gid, gt, small.
    """
    place = F.when(~F.col("excluded"), F.row_number().over(Window.partitionBy("gid", "excluded").orderBy("rank")))
    own, kept = F.col("code") == F.col("gt"), F.coalesce(F.col("place") <= k, F.lit(False))
    each = truths.join(candidates.withColumn("place", place), "gid", "left").groupBy("gid", "gt", "small").agg(
        F.coalesce(F.bool_or(own), F.lit(False)).alias("raw"), F.coalesce(F.bool_or(own & F.col("excluded")), F.lit(False)).alias("lost"), F.coalesce(F.bool_or(own & kept), F.lit(False)).alias("fused"),
        F.count_if(kept).alias("n_kept"), F.count_if(kept & (F.col("matches") == 4)).alias("full"), F.count_if(kept & (F.col("matches") >= 3)).alias("high"),
        F.coalesce(F.bool_or(own & (F.col("rank") == 1)), F.lit(False)).alias("plain"), F.coalesce(F.bool_or(own & (F.col("place") == 1)), F.lit(False)).alias("first"),
    )
    mean, part = lambda c: F.round(F.coalesce(F.avg(F.col(c).cast("int")), F.lit(0.0)), 6), lambda x, y: F.round(x / F.greatest(y, F.lit(1)), 6)
    small, plain = F.count_if("small"), F.count_if("plain")
    excluded, gone = F.count_if(F.col("small") & F.col("lost")), F.count_if(F.col("plain") & ~F.col("fused"))
    return each.agg(
        F.count(F.lit(1)).alias("n"), mean("fused").alias("ceiling"), small.alias("n_small"), excluded.alias("n_small_excluded"), part(excluded, small).alias("small_excluded"),
        part(F.sum("full"), F.sum("n_kept")).alias("full"), part(F.sum("high"), F.sum("n_kept")).alias("high"), plain.alias("n_plain"), gone.alias("n_plain_lost"), part(gone, plain).alias("plain_lost"),
        mean("raw").alias("in_raw"), mean("plain").alias("plain_top1"), mean("first").alias("first_top1"),
    )


def verdict(delta1, delta5, separated):
    """GO, WEAK, STOP or MIXED by the differences of both rates."""
    return F.when((delta1 >= 0.05) & (delta5 >= 0.05) & separated, "GO").when((delta1 >= 0.02) & (delta5 >= 0.02), "WEAK").when((delta1 < 0) | (delta5 < 0), "STOP").otherwise("MIXED")


def purity(rows: DataFrame, group: str, factor: str, label: str) -> DataFrame:
    """Share of a group's rows that its labels' majority explains, by factor value and without."""
    c = rows.groupBy(group, factor, label).agg(F.count(F.lit(1)).alias("n"))
    by_factor = c.groupBy(group, factor).agg(F.max("n").alias("m"), F.sum("n").alias("t")).groupBy(group).agg((F.sum("m") / F.sum("t")).alias("with_factor"))
    whole = c.groupBy(group, label).agg(F.sum("n").alias("n")).groupBy(group).agg((F.max("n") / F.sum("n")).alias("without"))
    return by_factor.join(whole, group).withColumn("gain", F.col("with_factor") - F.col("without"))


def order_statistics(df: DataFrame, key: str, x: str) -> DataFrame:
    """Upper median and p90 by floor(n * p), least, greatest and mean (A09); row numbers, no list is gathered."""
    w = Window.partitionBy(key)
    at = df.withColumn("_r", F.row_number().over(w.orderBy(x))).withColumn("_n", F.count(F.lit(1)).over(w))
    pick = lambda p: F.max(F.when(F.col("_r") == F.floor(F.col("_n") * p) + 1, F.col(x)))
    return at.groupBy(key).agg(pick(0.5).alias("upper_median"), pick(0.9).alias("p90"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"))


def backoff(prior: DataFrame, wanted: DataFrame, levels: list[list[str]], lists: list[str]) -> DataFrame:
    """Adds n: counts of the first level, the most special first, at which any candidate of the row's list has one.

    prior: the levels' columns and n.  ``lists`` names a list of candidates, which takes one level as a whole;
    a list without any count has zeros.
    """
    out, names = wanted, [f"_c{k}" for k in range(len(levels))]
    for c, level in zip(names, levels, strict=True):
        out = out.join(prior.groupBy(*level).agg(F.sum("n").alias(c)), level, "left").fillna(0, [c])
    w = Window.partitionBy(*lists)
    return out.withColumn("n", F.coalesce(*(F.when(F.max(c).over(w) > 0, F.col(c)) for c in names), F.lit(0))).drop(*names)


class Checked:
    """Rows with counts that are taken as the rows go by, and demands on them: one job, no second reading.

    ``rows`` may be used as any table; after an action on it, demand() raises if a condition was
    broken, with the number of rows that broke it.
    """

    def __init__(self, rows: DataFrame, broken: dict[str, Column]):
        self._seen = Observation()
        self.rows = rows.observe(self._seen, *(F.count_if(c).alias(name) for name, c in broken.items()))

    def demand(self) -> None:
        """Waits for the first action on ``rows``; call it after one."""
        if found := {name: n for name, n in self._seen.get.items() if n}:
            raise ValueError(", ".join(f"{n} rows: {name}" for name, n in found.items()))


def looked_up(left: DataFrame, right: DataFrame, key: str) -> Checked:
    """Rows of ``left`` with the right row of their key (J01); a key without one is an error, as in a lookup, and stays with nulls until demand()."""
    found = right.withColumn("_found", F.lit(True))
    both = left.join(found, key, "left")
    out = Checked(both, {f"no right row of {key}": F.col("_found").isNull()})
    out.rows = out.rows.drop("_found")
    return out


def group_ranks(lists: DataFrame, truth: DataFrame, groups: DataFrame) -> Checked:
    """(qid, exact_rank, group_rank): first place of the truth, and of any code of its group, null if none.

    lists: qid, code, rank; truth: qid, gt; groups: code, grp; a code without group is a
    group of its own.  Demands that the exact rank is never better than the group's.
    """
    group = lambda g, c: F.coalesce(g, F.concat(F.lit("SINGLETON::"), c))
    of = lambda c, n: groups.select(F.col("code").alias(c), F.col("grp").cast("string").alias(n))
    known = truth.select("qid", "gt").join(of("gt", "_gg"), "gt", "left")
    both = known.join(lists.select("qid", "code", "rank").join(of("code", "_cg"), "code", "left"), "qid", "left")
    same = group(F.col("_cg"), F.col("code").cast("string")) == group(F.col("_gg"), F.col("gt").cast("string"))
    out = both.groupBy("qid").agg(F.min(F.when(F.col("code") == F.col("gt"), F.col("rank"))).alias("exact_rank"), F.min(F.when(same, F.col("rank"))).alias("group_rank"))
    worse = F.col("exact_rank").isNotNull() & (F.col("group_rank").isNull() | (F.col("group_rank") > F.col("exact_rank")))
    return Checked(out, {"exact rank better than group rank": worse})


def gap(firsts: DataFrame) -> DataFrame:
    """(part, n) of the gap between the right group and the right code (M10): registry_variant, scale_tier, fine_applicability.

    firsts: pred, gt and for each _group, _family and _scale (null if unknown).  Only first
    places that are wrong but of the truth's group count: of another family, else of another
    known scale, else the rest.
    """
    scales = F.coalesce(F.col("pred_scale") != F.col("gt_scale"), F.lit(False))
    part = F.when(F.col("pred_family") != F.col("gt_family"), "registry_variant").when(scales, "scale_tier").otherwise("fine_applicability")
    return firsts.where("pred <> gt AND pred_group = gt_group").groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


def bootstrap(differences: DataFrame, draws: int = 20_000, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean of paired differences.

    Differences of -1, 0 and 1 are counted first, so that a draw is one multinomial:
    three numbers reach the task, however many pairs there are.
    """
    counts = differences.agg(F.count_if(F.col("d") < 0).alias("minus"), F.count_if(F.col("d") == 0).alias("zero"), F.count_if(F.col("d") > 0).alias("plus"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                n = r.minus + r.zero + r.plus
                if not n:
                    yield pd.DataFrame({"n": [0], "delta": [0.0], "low": [0.0], "high": [0.0]})
                    continue
                m = np.random.default_rng(seed).multinomial(n, np.array([r.minus, r.zero, r.plus]) / n, draws)
                means = np.sort((m[:, 2] - m[:, 0]) / n)
                yield pd.DataFrame({"n": [n], "delta": [(r.plus - r.minus) / n], "low": [means[int(0.025 * draws)]], "high": [means[int(0.975 * draws)]]})

    return counts.mapInPandas(draw, "n long, delta double, low double, high double")
