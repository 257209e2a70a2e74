"""Column functions for rates, intervals and paired tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Z = 1.96


def hit(rank: Column, k: int) -> Column:
    return F.when(rank <= k, 1.0).otherwise(0.0)


def reciprocal(rank: Column) -> Column:
    return F.coalesce(1.0 / rank, F.lit(0.0))


def metrics(rank: Column) -> list[Column]:
    """n, top1, top5 and mrr of a column of ranks, null where the truth was not found."""
    return [F.count(F.lit(1)).alias("n"), F.round(F.avg(hit(rank, 1)), 6).alias("top1"), F.round(F.avg(hit(rank, 5)), 6).alias("top5"), F.round(F.avg(reciprocal(rank)), 6).alias("mrr")]


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Interval of k successes in n; (0, 0) for n = 0."""
    p = k / n
    den = 1 + Z * Z / n
    mid, half = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (mid - half) / den)), F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), (mid + half) / den))


def mcnemar(b: Column, c: Column) -> Column:
    """Continuity-corrected statistic; 0 where no pair differs."""
    return F.when(b + c == 0, 0.0).otherwise(F.pow(F.abs(b - c) - 1, 2) / (b + c))


@F.pandas_udf(DoubleType())
def chi_p(x: pd.Series) -> pd.Series:
    """p of a chi-square statistic of one degree of freedom: one for 0."""
    return x.map(lambda v: 1.0 if not v else math.erfc(math.sqrt(v / 2)))
