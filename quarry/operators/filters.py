"""Constraint filters: registry, scale, validity in time, keywords, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import codes, keywords


#: Codes that a label space may have where every project meets every code.
MOST_CODES = 100_000


def pairs(projects: DataFrame, space: DataFrame) -> DataFrame:
    """Projects by codes of the label space, which has hundreds and may have MOST_CODES: counted here, more are an error."""
    if space.limit(MOST_CODES + 1).count() > MOST_CODES:
        raise ValueError(f"a label space of over {MOST_CODES} codes meets no project as a whole")
    return projects.crossJoin(space)


def keeps(registry: Column, code: Column, standard: Column) -> Column:
    """Whether a project's registry allows a code: of its own family or CDM's, or listed under it; unknown allows all."""
    fam = codes.family(code)
    own = lambda r: (registry == r) & (fam.isin(r, "CDM") | (standard == r))
    return ~F.coalesce(registry, F.lit("")).isin("GS", "VCS") | F.coalesce(own("GS") | own("VCS"), F.lit(False))


def registry_keep(projects: DataFrame, space: DataFrame) -> DataFrame:
    return pairs(projects, space).where(keeps(F.col("registry"), F.col("code"), F.col("standard")))


def scale_fits(scale: Column, code: Column) -> Column:
    """Not a large project with a small-scale code."""
    return ~((scale == "large") & code.startswith("AMS-"))


def allow_list(projects: DataFrame, space: DataFrame) -> DataFrame:
    """Counts of codes left after each stage."""
    a, b = keeps(F.col("registry"), F.col("code"), F.col("standard")), scale_fits(F.col("scale"), F.col("code"))
    return pairs(projects, space).groupBy("project").agg(F.count(F.lit(1)).alias("n_all"), F.count_if(a).alias("n_registry"), F.count_if(a & b).alias("n_scale"))


def staged(projects: DataFrame, space: DataFrame, *, dated: bool = False) -> DataFrame:
    """Adds to projects n_all, n_registry, n_date, n_scale: codes left after each stage, and n_boosted: those of its scope.

    projects(project, registry, start, scale, scope), space(code, standards, status, last, scopes): standards and
    scopes are arrays, last is the latest end of the code's versions, far off where one is
    open, null where it has none.  The date stage is asked for by ``dated``: a code goes if
    the start is known and it is withdrawn or all versions ended before.  Large projects, in
    any case, lose codes of small scale.  A scope's leading number, without its zero, marks codes and drops none.

    Projects meet the space once for each kind of project.
    """
    start = F.col("start") if dated else F.lit(None).cast("date")
    number = F.regexp_extract(F.trim(F.coalesce("scope", F.lit(""))), r"^0?(\d{1,2})", 1)
    kind = {"_r": F.coalesce("registry", F.lit("")), "_d": start, "_s": F.lower(F.coalesce("scale", F.lit("unknown"))), "_n": number}
    known = projects.withColumns(kind)
    x = pairs(known.select(*kind).distinct(), space)
    listed = F.when(F.array_contains("standards", F.col("_r")), F.col("_r"))
    a = keeps(F.col("_r"), F.col("code"), listed)
    ended = F.coalesce(F.col("status") == "Withdrawn", F.lit(False)) | F.coalesce(F.col("last") < F.col("_d"), F.lit(False))
    b = a & ~(F.col("_d").isNotNull() & ended)
    c = b & scale_fits(F.col("_s"), F.col("code"))
    boosted = c & (F.col("_n") != "") & F.coalesce(F.array_contains("scopes", F.col("_n")), F.lit(False))
    counts = {"n_all": F.count(F.lit(1)), "n_registry": F.count_if(a), "n_date": F.count_if(b), "n_scale": F.count_if(c), "n_boosted": F.count_if(boosted)}
    by_kind = x.groupBy(*kind).agg(*(v.alias(k) for k, v in counts.items())).select(*(F.col(k).alias(f"{k}_") for k in kind), *counts)
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in kind]
    return known.join(by_kind, same, "left").select(*projects.columns, *(F.coalesce(k, F.lit(0)).alias(k) for k in counts))


def invalid_at(dated: DataFrame, versions: DataFrame) -> DataFrame:
    """Adds invalid (F04): withdrawn, or every version ended before the date; no date or no version is valid.

    dated(gid, d, code), versions(code, ef, et, status); versions are summed by code before they meet the dates.
    """
    far = F.to_date(F.lit("9999-12-31"))
    by_code = versions.groupBy("code").agg(F.max((F.col("status") == "Withdrawn").cast("int")).alias("w"), F.max(F.coalesce("et", far)).alias("last"))
    return dated.join(by_code, "code", "left").withColumn("invalid", F.col("d").isNotNull() & (F.coalesce(F.col("w") == 1, F.lit(False)) | F.coalesce(F.col("last") < F.col("d"), F.lit(False)))).drop("w", "last")


def valid_at(dated: DataFrame, versions: DataFrame) -> DataFrame:
    """Adds valid (F05): some version's interval holds the date, open ends reaching far; no version is valid.

    An equi-join on the code with the interval as a further predicate.
    """
    low, high = F.coalesce("ef", F.to_date(F.lit("1900-01-01"))), F.coalesce("et", F.to_date(F.lit("2099-12-31")))
    v = versions.select("code", low.alias("lo"), high.alias("hi"))
    held = dated.join(v, "code", "left").groupBy("gid", "code", "d").agg(F.count("lo").alias("n"), F.max(F.when(F.col("d").between(F.col("lo"), F.col("hi")), 1).otherwise(0)).alias("in"))
    return held.withColumn("valid", (F.col("n") == 0) | (F.col("in") == 1))


def matched(candidates: DataFrame, *, text: str = "text", code: str = "code", scale: str = "scale", scope: str = "scope", technology: str = "technology", gases: str = "gases") -> DataFrame:
    """Adds match_count (0 to 4), matched (names of the features that do), excluded and reasons to candidates beside features."""
    flags = keywords.matches(F.col(text), F.col(code), scale=F.col(scale), scope=F.col(scope), technology=F.col(technology), gases=F.col(gases))
    names = F.array_compact(F.array(*[F.when(f, k) for k, f in flags.items()]))
    out = F.coalesce(~scale_fits(F.col(scale), F.col(code)), F.lit(False))
    reason = F.concat(F.lit("scale="), F.col(scale), F.lit(" but code is AMS-* (small-only)"))
    return candidates.withColumns({"matched": names, "excluded": out}).withColumns({"match_count": F.size("matched").cast("long"), "reasons": F.array_compact(F.array(F.when(F.col("excluded"), reason)))})


def valid_labels(said: DataFrame, space: DataFrame, k: int) -> DataFrame:
    """Codes of the label space in first-seen order, at most k; the score keeps the original place."""
    first = said.join(space, "code", "left_semi").groupBy("gid", "code").agg(F.min("pos").alias("pos"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("gid").orderBy("pos", "code"))).where(F.col("rank") <= k).withColumn("score", 1.0 / F.col("pos"))
